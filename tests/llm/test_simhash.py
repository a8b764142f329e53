import random
import re

import numpy as np
import pytest
import xxhash

from commitscope.llm import simhash
from commitscope.llm.common import Workspace
from commitscope.llm.components import connected_components


def brute_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_classes(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    prints = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(prints, 2)
    least = {}
    for (i, _), r in zip(docs, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(docs, prints, roots)), key=str)
    assert sorted((tuple(r) for r in simhash.near_classes(odd_docs).collect()), key=str) == want
    kept = simhash.drop_near(odd_docs)
    assert kept.dtypes == odd_docs.dtypes
    assert kept.count() == len(set(roots))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, least.values()))


def test_empty_table(no_docs):
    assert simhash.near_classes(no_docs).count() == 0
    assert simhash.drop_near(no_docs).count() == 0


@pytest.mark.parametrize("parts,tile", [(1, 40), (2, 16), (4, 2048), (8, 4), (16, 2048)])
def test_links_span_all_near_pairs(spark, parts, tile):
    rng = random.Random(parts)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for v in list(values)[:40]:  # chains of near values
        for _ in range(rng.randint(1, 6)):
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    work = Workspace(spark, "test")
    links = simhash.links(fps, work, 2, tile=tile, parts=parts)
    assert links.count() <= 4 * len(values) * (64 if tile < 100 else 1)
    root = {r.node: r.root for r in connected_components(links, work).collect()}
    roots = brute_components(values, 2)
    groups, want = {}, {}
    for s, r in zip(signed, roots):
        groups.setdefault(root.get(s, s), set()).add(s)
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_compare_returns_stars_not_pairs():
    same = np.array([1 << i for i in range(60)], dtype=np.uint64)  # all within two bits
    a, b = simhash.compare(same, same, 2)
    assert len(a) == 59 and len(set(b)) == 1


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 900), (900, 700)] + [(1000, i) for i in range(1001, 1100)]
    random.Random(1).shuffle(path)
    got = connected_components(spark.createDataFrame(path, "a long, b long"), Workspace(spark, "test")).collect()
    roots = {r.node: r.root for r in got}
    assert roots == {**{i: 0 for i in range(1, 201)}, 700: 500, 900: 500, **{i: 1000 for i in range(1001, 1100)}}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0
