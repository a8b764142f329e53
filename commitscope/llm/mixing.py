"""Mixing sources to target weights with a multivariate-hypergeometric
splitting tree.

1. ``targets``: each source's share of all words, water-filled under a cap of
   ``max_repeat`` times its size.
2. Documents are dealt to blocks of their source by a seeded hash, at least
   ``SOURCE_BLOCKS`` of each source that has as many rows.  Each source takes
   all its blocks as often as its target holds its size whole, then blocks in
   a permuted order while they fit: its exact block quota.  A task per source
   chooses them.
3. Sources are dealt to ``GROUPS`` groups.  ``split_quotas`` halves the range
   of output shards again and again and draws from a multivariate
   hypergeometric law how many blocks of each group go left, so each shard's
   block count is exact and its composition is that of a uniform shuffle.
   Shards then take consecutive runs of each group's permuted block draws: the
   runs are disjoint and use up the quota.  Only the groups' quotas reach the
   driver.
4. ``mix`` sends the documents to their shards and shuffles inside each.
   Shards beyond ``SHARD_WORDS`` words are cut into slices, a task each.
   ``measure`` writes a mixture and counts what it holds of each document.

All draws come from the seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, quoted

WEIGHTS = (5, 2, 1)
MAX_BLOCKS = 1 << 14
SOURCE_BLOCKS = 256
GROUPS = 256
MAX_SHARDS = 1 << 12
SHARD_WORDS = 1 << 27
SOURCE_NO, BLOCK, DRAWS = "_source_no", "_block", "_draws"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(quoted(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> list[float]:
    """Target words of each source (in rank order; weights repeat)."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weight[i] for i in free)
        share = {i: left * weight[i] / total for i in free}
        full = [i for i in free if share[i] > max_repeat * sizes[i]]
        if not full:
            for i in free:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """``(shards, sources)`` block counts: columns sum to ``quotas``, rows
    differ by one at most in their sum."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    work = [(0, shards, quotas.astype(np.int64))]
    while work:
        lo, hi, quota = work.pop()
        if hi - lo == 1:
            out[lo] = quota
            continue
        mid, n = (lo + hi) // 2, int(quota.sum())
        rng = np.random.default_rng([seed, lo, hi])
        # Blocks [n*lo', n*mid') of the shuffled whole: exact capacities.
        take = n * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(quota, take, method="marginals") if n else quota * 0
        work += [(lo, mid, left), (mid, hi, quota - left)]
    return out


def _partial(words: np.ndarray, want: float) -> np.ndarray:
    """Of blocks in permuted order: those that fit into ``want`` words one
    after the other; then, where it comes nearer, one left over is added or
    swapped for a chosen one."""
    chosen = np.zeros(len(words), dtype=bool)
    left = want
    for i, w in enumerate(words.tolist()):
        if w <= left:
            chosen[i] = True
            left -= w
    out, within = np.nonzero(~chosen & (words > 0))[0], np.nonzero(chosen)[0]
    if not len(out):
        return chosen
    # Words of the block to give back for each one left over (0: none).
    within = within[np.argsort(words[within], kind="stable")]
    back = np.concatenate(([0], words[within]))
    at = np.searchsorted(back, words[out] - left).clip(1, max(1, len(back) - 1)) if len(back) > 1 else np.zeros(len(out), int)
    options = np.concatenate([np.zeros(len(out), int), at, np.maximum(at - 1, 0)])
    who = np.tile(out, 3)
    gap = np.abs(left - (words[who] - back[options]))
    best = int(np.argmin(gap))
    if gap[best] < left:
        chosen[who[best]] = True
        if options[best]:
            chosen[within[options[best] - 1]] = False
    return chosen


@dataclass
class Plan:
    sources: DataFrame  # _name, _source_no, source_size, target, _blocks
    draws: DataFrame  # _source_no, _block, _draws
    slices: int  # tasks that share a shard


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: str) -> DataFrame:
    return docs.select(
        *[quoted(c) for c in more],
        quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"),
        size_of(text_col).alias("size"),
        F.xxhash64(F.lit(seed), quoted(id_col), quoted(text_col).cast("string")).alias("k"))


def _with_source(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    return keyed.join(sources, F.col("source").eqNullSafe(F.col("_name")))


def _with_block(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's number, size, target and the block."""
    return (_with_source(keyed, sources)
            .withColumn(BLOCK, F.pmod("k", F.col("_blocks").cast("long")).cast("int")).drop("_name", "_blocks"))


def _sources(keyed: DataFrame, work: Workspace, weights: tuple[int, ...], max_repeat: int) -> tuple[DataFrame, int]:
    """A row per source with its number (code-point order, null last), the
    target that ``targets`` gives it and its number of blocks; and all words."""
    per = work.stage(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "per")
    order = F.col("source").asc_nulls_last()
    ranged = work.stage(per.repartitionByRange(order).withColumn("p", F.spark_partition_id()), "ranged")
    counts = {r["p"]: r["count"] for r in ranged.groupBy("p").count().collect()}  # a row per partition
    before = np.cumsum([0] + [counts.get(p, 0) for p in range(max(counts, default=0) + 1)])
    number = F.get(F.lit([int(b) for b in before]), "p") + F.row_number().over(Window.partitionBy("p").orderBy(order)) - 1
    weight = F.get(F.lit([float(w) for w in weights]), F.col(SOURCE_NO) % len(weights))
    ranked = work.stage(ranged.withColumn(SOURCE_NO, number.cast("int")).withColumn("w", weight).drop("p"), "ranked")
    total = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap, share, rounds = max_repeat * F.col("source_size"), None, -1
    # The share only grows, so what is capped stays capped.
    while True:
        free = F.lit(True) if share is None else share <= cap
        held, w, n = ranked.agg(F.sum(F.when(free, 0).otherwise(cap)), F.sum(F.when(free, F.col("w"))),
                                F.count_if(free)).first()
        if n == rounds or not n:
            break
        rounds, share = n, F.lit(float(total - held)) * F.col("w") / F.lit(w)
    target = cap.cast("double") if share is None else F.when(share <= cap, share).otherwise(cap.cast("double"))
    block_words = max(1, -(-total // MAX_BLOCKS))
    blocks = F.least("rows", F.greatest(F.lit(SOURCE_BLOCKS), F.ceil(F.col("source_size") / block_words)))
    return work.stage(ranked.select(F.col("source").alias("_name"), SOURCE_NO, "source_size", target.alias("target"),
                                    blocks.cast("int").alias("_blocks")), "sources"), total


def _chosen(own: pd.DataFrame, max_repeat: int, seed: int) -> pd.DataFrame:
    """The block draws of one source."""
    own = own.sort_values(BLOCK)
    no, size, target = int(own[SOURCE_NO].iloc[0]), int(own["source_size"].iloc[0]), float(own["target"].iloc[0])
    rng = np.random.default_rng([seed, no])
    epochs, parts = (int(target // size), []) if size else (0, [])
    for epoch in range(epochs + 1):
        order = rng.permutation(len(own))
        ids, words = own[BLOCK].to_numpy()[order], own["words"].to_numpy()[order]
        if epoch == epochs:
            rest = target - epochs * size
            taken = _partial(words, rest) if size and epochs < max_repeat else np.zeros(len(words), dtype=bool)
            ids = ids[taken]
        parts += [(no, no % GROUPS, int(b), epoch) for b in ids]
    return pd.DataFrame(parts, columns=[SOURCE_NO, "_group", BLOCK, "epoch"])


def _dealt(own: pd.DataFrame, counts: np.ndarray, seed: int) -> pd.DataFrame:
    """The draws of one group with their shards, in runs of a permuted order."""
    own = own.sort_values([SOURCE_NO, "epoch", BLOCK], ignore_index=True)
    group = int(own["_group"].iloc[0])
    order = np.random.default_rng([seed, group, 1]).permutation(len(own))
    shard = np.empty(len(own), dtype=np.int32)
    shard[order] = np.repeat(np.arange(len(counts)), counts[:, group])
    return own[[SOURCE_NO, BLOCK, "epoch"]].assign(shard=shard)


def make_plan(keyed: DataFrame, weights: tuple[int, ...], max_repeat: int, seed: int) -> Plan:
    work = Workspace(keyed.sparkSession, "mixing-plan")
    sources, total = _sources(keyed, work, weights, max_repeat)
    blocks = (_with_block(keyed, sources).groupBy(SOURCE_NO, BLOCK)
              .agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"),
                   F.first("target").alias("target")))
    chosen = work.stage(blocks.groupBy(SOURCE_NO).applyInPandas(
        lambda own: _chosen(own, max_repeat, seed), f"{SOURCE_NO} int, _group int, {BLOCK} int, epoch int"), "chosen")
    quotas = np.zeros(GROUPS, dtype=np.int64)
    for r in chosen.groupBy("_group").count().collect():  # at most GROUPS rows
        quotas[r["_group"]] = r["count"]
    shards = int(min(MAX_SHARDS, max(1, -(-total // SHARD_WORDS), min(64, int(quotas.sum())))))
    counts = split_quotas(quotas, shards, seed)
    dealt = chosen.groupBy("_group").applyInPandas(
        lambda own: _dealt(own, counts, seed), f"{SOURCE_NO} int, {BLOCK} int, epoch int, shard int")
    draws = dealt.groupBy(SOURCE_NO, BLOCK).agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias(DRAWS))
    return Plan(sources, work.stage(draws, "draws"), max(1, -(-total // (shards * SHARD_WORDS))))


def _draws(dealt: DataFrame, plan: Plan) -> DataFrame:
    """``dealt`` with the draws of each row's block."""
    return (dealt.join(plan.draws, [SOURCE_NO, BLOCK], "left")
            .withColumn(DRAWS, F.coalesce(DRAWS, F.array().cast("array<struct<epoch:int,shard:int>>"))))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: int = 20) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target,
    draws`` (one ``{epoch, shard}`` for each time the mix takes it).

    Null texts have size 0; a null source is a source of its own, ranked
    last.  Rows with equal id and text are dealt and drawn alike.  An empty
    table gives no rows; other columns are ignored.
    """
    keyed = Workspace(docs.sparkSession, "mixing").stage(_keyed(docs, id_col, text_col, source_col, seed), "sizes")
    plan = make_plan(keyed, weights, max_repeat, seed)
    return _draws(_with_block(keyed, plan.sources), plan).select(
        "doc_id", "source", "size", "source_size", "target", F.col(DRAWS).alias("draws"))


def _mixed(docs: DataFrame, plan: Plan, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``row`` (a struct of ``docs``' columns) and ``shard``."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       quoted(source_col).cast("string").alias("source"),
                       F.xxhash64(F.lit(seed), quoted(id_col), quoted(text_col).cast("string")).alias("k"))
    taken = (_draws(_with_block(rows, plan.sources), plan).select("row", "k", F.explode(DRAWS).alias("draw"))
             .select("row", F.col("draw.shard").alias("shard"),
                     F.xxhash64(F.lit(seed), "draw.shard", "draw.epoch", "k").alias("place")))
    order = ["shard"]
    if plan.slices > 1:
        taken = taken.withColumn("slice", F.pmod("place", F.lit(plan.slices)))
        order.append("slice")
    return taken.repartition(*order).sortWithinPartitions(*order, "place").select("row", "shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: int = 20) -> DataFrame:
    """The mixture itself: ``docs``' columns, a row for each time a document
    is taken, shard by shard, each shard in a random order of its own.

    Null and empty texts have size 0 and come with their block; a null source
    is a source of its own, ranked last.  Rows with equal id and text are
    taken alike, each as often.  An empty table, or one without words, gives
    no rows; other columns pass through, whatever their names.
    """
    keyed = Workspace(docs.sparkSession, "mixing").stage(_keyed(docs, id_col, text_col, source_col, seed), "sizes")
    plan = make_plan(keyed, weights, max_repeat, seed)
    return _mixed(docs, plan, id_col, text_col, source_col, seed).select("row.*")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: int = 20) -> DataFrame:
    """Writes the mixture to the shared folder and reads it back: a row per
    input row with ``doc_id, size, source_size, target``, ``taken`` (words
    that the written shards hold of the row, repeats counted) and ``shards``
    (those it stands in, ascending).

    Nulls, empty texts and tables as in ``mix``; of rows with equal id, text
    and source, each has its equal part of what the shards hold.
    """
    work = Workspace(docs.sparkSession, "mixing")
    keyed = work.stage(_keyed(docs, id_col, text_col, source_col, seed), "sizes")
    plan = make_plan(keyed, weights, max_repeat, seed)
    mixture = work.stage(_mixed(docs, plan, id_col, text_col, source_col, seed), "mixture")
    held = mixture.select("row.*", F.col("shard").alias(shard := fresh("shard", docs.columns)))
    same = ["doc_id", "source", "k"]
    written = _keyed(held, id_col, text_col, source_col, seed, shard).select(
        *same, F.lit(0).alias("rows"), F.col("size").alias("words"), F.col(shard).alias("shard"))
    given = keyed.select(*same, F.lit(1).alias("rows"), F.lit(0).alias("words"), F.lit(None).cast("int").alias("shard"))
    # A row stands in at most as many shards as it is taken.
    found = written.unionByName(given).groupBy(*same).agg(
        F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.array_sort(F.collect_set("shard")).alias("shards"))
    found = found.toDF(*["f_" + c for c in same], "rows", "words", "shards")
    whole = _with_source(keyed, plan.sources)
    equal = [whole[c].eqNullSafe(found["f_" + c]) for c in same]
    return whole.join(found, equal[0] & equal[1] & equal[2]).select(
        "doc_id", "size", "source_size", "target", F.expr("words DIV rows").alias("taken"), "shards")
