"""Running (prefix) computations that survive a hot key.

A window ``partitionBy(key).orderBy(seq)`` puts every row of a key into one
task.  When one session or repository may hold a third of all rows, that
task is the job.  These helpers split each key's order range into buckets
(``seq div width``) and scan in two levels:

1. per (key, bucket): the bucket's own partial result (an aggregate, so it
   combines map-side and ships one row per bucket and task);
2. per key: a window over the *bucket* rows only (a few per key) gives the
   carry-in of every bucket;
3. per (key, bucket): the in-bucket window, plus the carry-in.

Step 3 is partitioned by (key, bucket), so a hot key is spread over as many
tasks as it has buckets, and the join that brings the carry-in shares that
partitioning (no extra exchange before the window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def _bucket(order_col: str, width: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(width)).cast("long")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value, out,
                width: int = DEFAULT_WIDTH, inclusive: bool = True) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same key at or before this
    row (``inclusive``) or strictly before it, in ``order`` (the first order
    column is numeric and defines the buckets).  ``value``/``out`` may be
    lists to sum several columns in the same pass."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    b = df.withColumn("_b", _bucket(order[0], width))
    per = b.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_bsum{i}") for i, v in enumerate(values)])
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_bsum{i}").over(wk), F.lit(0)).alias(f"_carry{i}")
                                      for i in range(len(values))])
    inner_end = 0 if inclusive else -1
    wb = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, inner_end)
    joined = b.join(carry, keys + ["_b"], "left")
    joined = joined.withColumns({o: F.coalesce(F.sum(v).over(wb), F.lit(0)) + F.col(f"_carry{i}")
                                 for i, (v, o) in enumerate(zip(values, outs))})
    return joined.drop("_b", *[f"_carry{i}" for i in range(len(values))])


def running_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                 width: int = DEFAULT_WIDTH, inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """``out`` = the last non-NULL ``value`` at or before this row in
    ``order`` (``reverse``: the first non-NULL one at or after it, i.e. the
    last one looking backwards from the end).  ``inclusive=False`` excludes
    the row itself."""
    b = df.withColumn("_b", _bucket(order[0], width))
    ordering = [F.col(c).desc() for c in order] if reverse else [F.col(c) for c in order]
    pick = F.max_by if not reverse else F.min_by
    rank = F.struct(*[F.col(c) for c in order])
    per = b.groupBy(*keys, "_b").agg(
        pick(F.col(value), F.when(F.col(value).isNotNull(), rank)).alias("_blast"))
    bucket_order = F.col("_b").desc() if reverse else F.col("_b")
    wk = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", F.last("_blast", ignorenulls=True).over(wk).alias("_carry"))
    inner_end = 0 if inclusive else -1
    wb = Window.partitionBy(*keys, "_b").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, inner_end)
    joined = b.join(carry, keys + ["_b"], "left")
    return (joined.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(wb), F.col("_carry")))
            .drop("_b", "_carry"))


def after_sum_and_max(df: DataFrame, keys: list[str], order: list[str], summed: str, greatest: str,
                      width: int = DEFAULT_WIDTH) -> DataFrame:
    """Replaces ``summed`` by its sum and ``greatest`` by its maximum over the
    rows of the same key that come after this one in ``order`` (0 and NULL
    where there is none).  Rows with a NULL key column stand alone."""
    b = df.withColumn("_b", _bucket(order[0], width))
    per = b.groupBy(*keys, "_b").agg(F.sum(summed).alias("_bsum"), F.max(greatest).alias("_bmax"))
    # Descending, so that the frame grows by a row: one that ends behind the
    # last row is computed anew for every row.
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", F.sum("_bsum").over(later).alias("_csum"), F.max("_bmax").over(later).alias("_cmax"))
    inner = (Window.partitionBy(*keys, "_b").orderBy(*[F.col(c).desc() for c in order])
             .rowsBetween(Window.unboundedPreceding, -1))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    joined = b.join(carry, keys + ["_b"], "left").withColumns(
        {"_isum": F.sum(summed).over(inner), "_imax": F.max(greatest).over(inner)})
    total = F.coalesce("_isum", F.lit(0)) + F.coalesce("_csum", F.lit(0))
    return (joined.withColumns({summed: F.when(known, total).otherwise(F.lit(0)),
                                greatest: F.when(known, F.greatest("_imax", "_cmax"))})
            .drop("_b", "_csum", "_cmax", "_isum", "_imax"))


def running_count(df: DataFrame, keys: list[str], order: list[str], out: str,
                  width: int = DEFAULT_WIDTH) -> DataFrame:
    """0-based position of each row within its key in ``order`` (a
    ``row_number() - 1`` that a hot key cannot stall)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, keys, order, "_one", out, width, inclusive=False).drop("_one")
