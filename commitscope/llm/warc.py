"""WARC archives as a PySpark data source.

``spark.read.format("warc")`` plans one partition per archive file, takes
predicates on the record type and on other header columns, reads each
record's headers first and passes over the payload of a record that fails
them.  Each record is a gzip member of its own, written with the member's
length in an extra field (``sl``), so that a reader seeks past unwanted
members without inflating them; members without it are inflated and thrown
away.  Plain ``.warc`` files are passed over by their content length.

``df.write.format("warc")`` writes a file per task under a name of its own;
the driver then lists the files of successful tasks in ``_files.json``, and
only those count, so lost or repeated tasks leave nothing behind that is
read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    IsNotNull, WriterCommitMessage)

from .common import Workspace, quoted

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, "
          "refers_to string, payload_bytes long, payload binary")
# Column -> header, for predicates that headers decide.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
LISTING = "_files.json"
SALTS = 16  # tasks that share the copies of one payload
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return pafs.LocalFileSystem(), path


# -- records ----------------------------------------------------------------

def _bare(value: str | None, column: str) -> str | None:
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    if column == "payload_digest":
        return value.partition(":")[2] or value
    return value


def _clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(row) -> bytes:
    """A record; a revisit keeps the HTTP headers and drops the payload."""
    payload = bytes(row["payload"] or b"")
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"),
             ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"]),
             ("WARC-Payload-Digest", row["payload_digest"] and "sha1:" + row["payload_digest"]),
             ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>"),
             ("WARC-Profile", PROFILE if row["record_type"] == "revisit" else None),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in lines if v is not None).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if size > 0xFFFFFFFF:  # too long for the field: readers inflate it
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = struct.pack("<2sHII", b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _parse_head(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.strip().lower()] = value.strip()
    return out


class _Records:
    """Walks the records of one open file: ``next_head`` reads headers,
    ``block`` the content, and whatever isn't asked for is passed over."""

    CHUNK = 1 << 16

    def __init__(self, f, compressed: bool):
        self.f, self.compressed = f, compressed
        self.size = f.size()
        self.at = 0

    def _inflate_more(self) -> bool:
        """More plain bytes of the current member into ``self.plain``."""
        while not self.packed.eof:
            data = self.packed.unconsumed_tail or self.f.read(self.CHUNK)
            if not data:
                raise EOFError("archive ends within a record")
            got = self.packed.decompress(data, self.CHUNK)
            if got:
                self.plain += got
                return True
        return False

    def next_head(self) -> dict[str, str] | None:
        if self.at >= self.size:
            return None
        self.f.seek(self.at)
        self.plain = bytearray()
        self.end = None
        if self.compressed:
            start = self.f.read(24)
            if len(start) == 24 and start[3] & 4 and start[12:14] == b"sl":
                self.end = self.at + struct.unpack_from("<I", start, 16)[0]
            self.f.seek(self.at)
            self.packed = zlib.decompressobj(16 + zlib.MAX_WBITS)
        while b"\r\n\r\n" not in self.plain:
            if self.compressed:
                if not self._inflate_more():
                    raise ValueError("record without an end of headers")
            else:
                data = self.f.read(self.CHUNK)
                if not data:
                    raise EOFError("archive ends within headers")
                self.plain += data
        cut = self.plain.index(b"\r\n\r\n") + 4
        head = _parse_head(bytes(self.plain[:cut - 4]))
        self.body, self.length = cut, int(head["content-length"])
        return head

    def _more(self, want: int) -> None:
        if self.compressed:
            more = self._inflate_more()
        else:
            data = self.f.read(min(self.CHUNK, want - len(self.plain)))
            self.plain += data
            more = bool(data)
        if not more:
            raise EOFError("archive ends within a record")

    def block(self) -> bytes:
        want = self.body + self.length
        while len(self.plain) < want:
            self._more(want)
        return bytes(self.plain[self.body:want])

    def http_head(self) -> tuple[bytes, int]:
        """The HTTP headers and the length of what follows, which is left
        unread."""
        want, seen = self.body + self.length, self.body
        while (cut := self.plain.find(b"\r\n\r\n", seen, want)) < 0:
            if len(self.plain) >= want:
                return bytes(self.plain[self.body:want]), 0
            seen = max(self.body, len(self.plain) - 3)
            self._more(want)
        return bytes(self.plain[self.body:cut]), want - cut - 4

    def skip(self) -> None:
        if not self.compressed:
            self.at += self.body + self.length + 4
        elif self.end is not None:
            self.at = self.end
        else:
            while self._inflate_more():
                self.plain = bytearray()
            self.at = self.f.tell() - len(self.packed.unused_data)


# -- the data source --------------------------------------------------------

@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Takes ``=``, ``IN`` and ``IS NOT NULL`` on header columns."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, frozenset()))
            else:
                yield f

    def partitions(self):
        fs, root = _filesystem(self.path)
        listing = fs.get_file_info(f"{root}/{LISTING}")
        if listing.type == pafs.FileType.File:
            with fs.open_input_file(listing.path) as f:
                names = [f"{root}/{name}" for name in json.loads(f.read())]
        elif fs.get_file_info(root).type == pafs.FileType.File:
            names = [root]
        else:
            names = [i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True))
                     if i.path.endswith((".warc", ".warc.gz"))]
        return [WarcFile(name) for name in sorted(names)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            records = _Records(f, partition.path.endswith(".gz"))
            while (head := records.next_head()) is not None:
                values = {c: _bare(head.get(h), c) for c, h in HEADERS.items()}
                if all(values[c] is not None and (not want or values[c] in want) for c, want in self.wanted):
                    payload, size = None, records.length
                    if "http" in head.get("content-type", ""):
                        http, size = records.http_head()
                        # What a revisit doesn't hold, its HTTP headers tell.
                        if values["record_type"] == "revisit":
                            size = int(_parse_head(b"\r\n" + http).get("content-length", size))
                        elif self.with_payload:
                            payload = records.block()[records.length - size:]
                    elif self.with_payload and values["record_type"] != "revisit":
                        payload = records.block()
                    yield *values.values(), size, payload
                records.skip()


@dataclass
class WarcWritten(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WarcWritten:
        first = next(iterator, None)
        if first is None:
            return WarcWritten(None)
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(gzip_member(record_bytes(first)))
            for row in iterator:
                f.write(gzip_member(record_bytes(row)))
        return WarcWritten(name)

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(m.name for m in messages if m is not None and m.name)
        with fs.open_output_stream(f"{root}/{LISTING}", compression=None) as f:
            f.write(json.dumps(names).encode())


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive folder or file; without ``payload`` the column
    is null and contents aren't copied out."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write_warc(records: DataFrame, path: str) -> None:
    """``records`` with the columns of ``SCHEMA``; a file per task."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("path", path).mode("append").save()


# -- archives of pages ------------------------------------------------------

def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four letters."""
    digits = F.sha1(data)
    letters = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*letters), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> str:
    """Writes one record per page and returns the archive's folder.

    Of pages with equal payloads of ``min_revisit_bytes`` and more, those
    with the smallest id are responses and the others revisits of it (a null
    id is above all others; rows that share the smallest id are all
    responses).  Payloads are equal if their SHA-256 is.  Null html counts as
    empty; an empty table writes no file.

    Which page comes first is found on rows without payloads, dealt out by
    digest and salt; payloads then meet the ids of responses by (digest, id),
    so copies of one payload never meet in one task.
    """
    work = Workspace(pages.sparkSession, "warc")
    path = path or f"{work.path}/archive"
    payload = F.coalesce(quoted(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("target_uri"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    narrow = work.stage(rows.select(
        "id", "target_uri", "key", sha1_base32(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "narrow")
    least = narrow.groupBy("key", "salt").agg(F.min("id").alias("least"), F.max("payload_bytes").alias("size"))
    first = work.stage(least.select("key", "salt", "size", F.min("least").over(Window.partitionBy("key")).alias("first"))
                       .withColumn("whole", F.col("size") < min_revisit_bytes), "first")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisits = narrow.join(first, ["key", "salt"]).filter(~F.col("whole") & ~F.col("id").eqNullSafe(F.col("first"))).select(
        F.lit("revisit").alias("record_type"), name("id").alias("record_id"), "target_uri", F.lit(date).alias("date"),
        "payload_digest", name("first").alias("refers_to"), "payload_bytes", F.lit(None).cast("binary").alias("payload"))
    answered = first.filter(~F.col("whole")).select(F.col("key").alias("k"), F.col("first").alias("f")).distinct()
    responses = rows.join(answered, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("f")), "left_semi")
    if min_revisit_bytes > 0:
        responses = responses.filter(F.octet_length("payload") >= min_revisit_bytes).unionByName(
            rows.filter(F.octet_length("payload") < min_revisit_bytes))
    responses = responses.select(
        F.lit("response").alias("record_type"), name("id").alias("record_id"), "target_uri", F.lit(date).alias("date"),
        sha1_base32(F.col("payload")).alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    write_warc(responses.unionByName(revisits), path)
    return path


def page_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of
    an archive that ``archive_pages`` wrote.

    Size and digest of responses are those of the payload that was read; the
    job fails if the digest isn't the one in the headers.  Revisits hold no
    payload: theirs come from their headers, and no payload is inflated to
    read them.
    """
    page = lambda c: F.nullif(F.substring_index(F.col(c), "urn:page:", -1), F.lit("")).cast(id_type)
    columns = [page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
               page("refers_to").alias("refers_to")]
    digest = sha1_base32(F.col("payload"))
    broken = F.raise_error(F.concat(F.lit("damaged payload of record "), F.coalesce("record_id", F.lit("?"))))
    responses = (read_warc(spark, path).filter(F.col("record_type") == "response")
                 .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
                 .withColumn("payload_digest", F.when(digest == F.col("payload_digest"), digest)
                             .otherwise(broken.cast("string"))))
    revisits = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    return responses.select(*columns).unionByName(revisits.select(*columns))
