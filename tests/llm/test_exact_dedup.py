import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from commitscope.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        top = True
        for i in sorted(ids, key=lambda i: i != keep):
            out[(i, keep, len(ids), i == keep and top, sha)] += 1
            top = top and i != keep
    return out


@pytest.mark.parametrize("capacity", [1, 256])
def test_classes_match_grouping(odd_docs, capacity):
    got = Counter(tuple(r) for r in exact_dedup.classes(odd_docs, capacity=capacity).collect())
    assert got == expected([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_drop_copies_keeps_one_row_and_all_columns(odd_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    rows = kept.collect()
    want = {(k[0], k[4]) for k in expected([(r.doc_id, r.text) for r in odd_docs.collect()]) if k[3]}
    assert len(rows) == len(want)
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows} == want


def test_empty_table(no_docs):
    assert exact_dedup.classes(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_all_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.group_size, r.kept) for r in exact_dedup.classes(docs).collect())
    assert got == Counter([(None, 2, True), (None, 2, False), (None, 1, True)])
    assert exact_dedup.drop_copies(docs).count() == 2


@pytest.mark.parametrize("seed", range(5))
def test_directory_splits_and_doubles(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, 256) * (rng.random(256) < 0.4)
    counts[rng.integers(256)] = 500  # one slot that no split can thin out
    d = exact_dedup.Directory(counts, capacity=20)
    assert len(d.slots) == 1 << d.depth and max(d.local_depths) == d.depth
    assert (np.diff(d.slots) >= 0).all() and set(d.slots) == set(range(len(d)))  # ranges in key order
    for b, local in enumerate(d.local_depths):
        assert (d.slots == b).sum() == 1 << (d.depth - local)
        assert d.weights[b] <= 20 or local == 8
    assert d.weights.sum() == counts.sum()
    hashes = rng.integers(-2**63, 2**63, 1000)
    top = (hashes.view(np.uint64) >> np.uint64(56)).astype(int)
    assert (d.bucket_of(hashes) == d.slots[top >> (8 - d.depth)]).all()
    owners = d.owners(4)
    assert (np.diff(owners) >= 0).all() and owners.min() == 0


def test_hash_collisions_are_told_apart():
    import pyarrow as pa

    own = exact_dedup._own(pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 4, pa.int32()), pa.array([7, 7, 7, 8]), pa.array(["a", "b", "a", "a"]),
         pa.array([1, 2, 3, 4]), pa.array([1, 1, 2, 1]), pa.array([1, 1, 1, 1])],
        names=["bucket", "h", "text", "keep_id", "n", "n_top"])
    rows = [tuple(r.values()) for b in own(iter([batch])) for r in b.to_pylist()]
    assert sorted(rows) == [(0, 7, "a", 3, 3, 1), (0, 7, "b", 2, 1, 1), (0, 8, "a", 4, 1, 1)]
