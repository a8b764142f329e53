import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from commitscope.llm import warc

PAGES = [(3, "http://a", "<p>x</p>"), (1, "http://b\r\nX: y", "<p>x</p>"), (2, None, None), (9, "http://c", ""),
         (4, "http://d", "é" * 70_000), (5, "http://e", "<p>unique\r\n\r\nWARC/1.1</p>"), (1, "http://f", "<p>x</p>"),
         (None, "http://g", "<p>x</p>"), (None, None, "only nulls")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "r", 1) for p in PAGES],
                                 "page_id long, url string, html string, record_type string, payload int")


def expected(least=0):
    out = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        again = page != first and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, pages, least):
    path = warc.archive_pages(pages, min_revisit_bytes=least)
    assert sorted((tuple(r) for r in warc.page_records(spark, path).collect()), key=str) == expected(least)
    full = warc.read_warc(spark, path)
    html = {(p, h or "") for p, _, h in PAGES}
    for r in full.filter("record_type = 'response'").collect():
        page = r.record_id.removeprefix("urn:page:")
        assert (int(page) if page else None, bytes(r.payload).decode()) in html
        assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
    assert full.filter("record_type = 'revisit' and payload is not null").count() == 0


def test_predicates_are_pushed_down(spark, pages):
    path = warc.archive_pages(pages)
    some = warc.read_warc(spark, path).filter("record_type = 'revisit' and refers_to in ('urn:page:1')")
    assert some.count() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter", 1)[1].split("\n", 1)[0] if "Filter" in plan else True


class Counting(warc._Records):
    inflated = 0

    def _inflate_more(self):
        Counting.inflated += 1
        return super()._inflate_more()


def _write(path, members):
    with open(path, "wb") as f:
        for m in members:
            f.write(m)


def test_members_are_skipped_without_inflating(tmp_path, monkeypatch):
    import os
    rows = [{"record_type": t, "record_id": f"urn:page:{i}", "target_uri": "http://x", "date": "d", "payload_digest": "D",
             "refers_to": None, "payload_bytes": None, "payload": os.urandom(300_000)}
            for i, t in enumerate(["response", "metadata", "response"])]
    data = [warc.record_bytes(r) for r in rows]
    monkeypatch.setattr(warc, "_Records", Counting)

    def read(name, members):
        _write(tmp_path / name, members)
        reader = warc.WarcReader(str(tmp_path / name), True)
        reader.wanted = [("record_type", frozenset(["metadata"]))]
        Counting.inflated = 0
        (part,) = reader.partitions()
        out = list(reader.read(part))
        return [(r[1], r[6], r[7] == rows[1]["payload"]) for r in out], Counting.inflated

    good = [("urn:page:1", 300_000, True)]
    got, with_length = read("a.warc.gz", [warc.gzip_member(d) for d in data])
    assert got == good
    got, without = read("b.warc.gz", [gzip.compress(d) for d in data])
    assert got == good and with_length < without
    assert read("c.warc", data) == (good, 0)


def test_sizes_are_told_without_inflating_payloads(tmp_path, monkeypatch):
    import os
    rows = [{"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": "http://x", "date": "d",
             "payload_digest": "D", "refers_to": None, "payload_bytes": None, "payload": p}
            for i, p in enumerate([os.urandom(900_000), b"", b"a\r\n\r\nb"])]
    monkeypatch.setattr(warc, "_Records", Counting)
    for name, members in [("a.warc.gz", [warc.gzip_member(warc.record_bytes(r)) for r in rows]),
                          ("b.warc", [warc.record_bytes(r) for r in rows])]:
        _write(tmp_path / name, members)
        for with_payload in (False, True):
            reader = warc.WarcReader(str(tmp_path / name), with_payload)
            Counting.inflated = 0
            out = list(reader.read(warc.WarcFile(str(tmp_path / name))))
            assert [r[6] for r in out] == [900_000, 0, 6]
            assert [r[7] for r in out] == ([r["payload"] for r in rows] if with_payload else [None] * 3)
            assert with_payload or Counting.inflated <= 3


def test_a_damaged_payload_fails_the_job(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.archive_pages(pages, path)
    assert warc.page_records(spark, path).count() == len(PAGES)
    good = warc.read_warc(spark, path).collect()
    rows = [r.asDict() for r in good]
    next(r for r in rows if r["record_id"] == "urn:page:5")["payload"] = b"something else"
    broken = str(tmp_path / "broken")
    warc.write_warc(spark.createDataFrame([tuple(r.values()) for r in rows], warc.SCHEMA), broken)
    with pytest.raises(Exception, match="damaged payload of record urn:page:5"):
        warc.page_records(spark, broken).collect()


def test_many_copies_of_one_payload(spark):
    pages = spark.range(3_000).selectExpr(
        "id AS page_id", "'u' AS url", "CASE WHEN id % 3 > 0 THEN 'same' ELSE concat('own ', id) END AS html")
    got = warc.page_records(spark, warc.archive_pages(pages)).toPandas()
    assert (got.record_type == "revisit").sum() == 1_999 and set(got.refers_to.dropna()) == {1}
    assert sorted(got.page_id) == list(range(3_000))


def test_members_are_plain_gzip():
    data = b"abc" * 1000
    assert gzip.decompress(warc.gzip_member(data) + warc.gzip_member(b"") + warc.gzip_member(data)) == data * 2


def test_uncommitted_files_are_not_read(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.archive_pages(pages, path)
    n = warc.read_warc(spark, path).count()
    fs = pafs.LocalFileSystem()
    part = next(i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".gz"))
    fs.copy_file(part, f"{path}/part-of-a-lost-task.warc.gz")
    assert warc.read_warc(spark, path).count() == n


def test_empty_table(spark, pages):
    assert warc.page_records(spark, warc.archive_pages(pages.limit(0))).count() == 0
