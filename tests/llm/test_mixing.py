import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from commitscope.llm import mixing

from .conftest import SF


def brute_targets(sizes, weights=(5, 2, 1)):
    w = [weights[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [3 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[10], [0, 0], [1, 100, 100, 3], [5, 0, 7, 1000, 2, 2, 2], [10**6] * 20])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(brute_targets(sizes)) and sum(got) == pytest.approx(sum(sizes))


def test_split_quotas_are_exact_and_reproducible():
    quotas = np.array([1000, 37, 0, 5])
    a = mixing.split_quotas(quotas, 13, 1)
    assert (a.sum(axis=0) == quotas).all() and (a >= 0).all()
    assert a.sum(axis=1).max() - a.sum(axis=1).min() <= 1
    assert (a == mixing.split_quotas(quotas, 13, 1)).all() and (a != mixing.split_quotas(quotas, 13, 2)).any()
    # Each shard's share of a source follows the hypergeometric mean.
    many = np.mean([mixing.split_quotas(quotas, 4, s)[0, 1] for s in range(300)])
    assert abs(many - 37 / 4) < 0.6


def test_assign_meets_targets_and_agrees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.assign(docs).collect()
    assert {tuple(map(str, r)) for r in rows} == {tuple(map(str, r)) for r in mixing.assign(docs.repartition(3)).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    taken, target, largest, size = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        assert len(r.draws) <= 3 and len({d.epoch for d in r.draws}) == len(r.draws)
        taken[r.source] += r["size"] * len(r.draws)
        size[r.source] += r["size"]
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    names = sorted(size)
    assert [target[s] for s in names] == pytest.approx(brute_targets([size[s] for s in names]))
    for s in names:
        assert abs(taken[s] - target[s]) <= max(largest[s] / 2, 0.02 * target[s])


def test_targets_are_met_with_many_sources(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 700:03}") for i in range(700 * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    by = (mixing.assign(docs).groupBy("source").agg({"size": "sum", "target": "max", "*": "count"})
          .withColumnRenamed("sum(size)", "size").withColumnRenamed("max(target)", "target").collect())
    assert len(by) == 700
    names = {r.source: r for r in by}
    want = brute_targets([names[s]["size"] for s in sorted(names)])
    assert [names[s].target for s in sorted(names)] == pytest.approx(want)
    taken = {r.source: r.taken for r in mixing.assign(docs).selectExpr("source", "size * size(draws) AS taken")
             .groupBy("source").agg({"taken": "sum"}).toDF("source", "taken").collect()}
    assert max(abs(taken[s] - names[s].target) / names[s].target for s in names) < 0.01


def test_mix_returns_the_assigned_rows(odd_docs):
    want = Counter()
    for r in mixing.assign(odd_docs).collect():
        assert r.source_size is not None and r["size"] * len(r.draws) <= 3 * r["size"]
        want[(r.doc_id, r.source, r["size"])] += len(r.draws)
    mixed = mixing.mix(odd_docs)
    assert mixed.dtypes == odd_docs.dtypes
    got = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect())
    assert got == +want


def test_null_source_is_last(odd_docs):
    rows = mixing.assign(odd_docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += r["size"]
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, brute_targets([size[s] for s in names])))
    assert all(r.target == pytest.approx(want[r.source]) for r in rows)


def test_empty_table_and_empty_texts(spark, no_docs):
    assert mixing.assign(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r.source_size, r.target, r.draws) for r in mixing.assign(blank).collect()] == [(0, 0, 0.0, [])] * 2
    assert mixing.mix(blank).count() == 0


def _measured(docs):
    return Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken, tuple(r.shards)) for r in mixing.measure(docs).collect())


def _assigned(docs):
    return Counter((r.doc_id, r["size"], r.source_size, r.target, r["size"] * len(r.draws), tuple(sorted({d.shard for d in r.draws})))
                   for r in mixing.assign(docs).collect())


def test_the_written_mixture_holds_what_was_assigned(spark, odd_docs, no_docs):
    assert _measured(odd_docs) == _assigned(odd_docs)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS shard", "2 AS `row`", "3 AS k")
    assert _measured(docs) == _assigned(docs)
    again = docs.unionByName(docs.limit(40)).unionByName(docs.limit(30).withColumn("source", docs.lang))
    assert _measured(again) == _assigned(again)
    assert mixing.measure(no_docs).count() == 0


def test_long_shards_are_shared_by_tasks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(r.doc_id for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_SHARDS", 2)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5_000)
    plans = []
    make = mixing.make_plan
    monkeypatch.setattr(mixing, "make_plan", lambda *a: plans.append(make(*a)) or plans[-1])
    mixed = mixing.mix(docs)
    assert plans[0].slices > 2
    assert Counter(r.doc_id for r in mixed.collect()) == want
