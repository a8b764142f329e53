"""DataFrame-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` evaluated on ``df``'s computed columns.

    A plain filter on a column that an expensive in-row expression produced
    (a parsed file list, a group array) is pushed below the projection that
    computes it, and the optimizer inlines the whole expression into the
    predicate, so every row is parsed twice.  Filtering through an outer
    generator keeps the predicate above the projection: the generator reads
    the column once, and rows whose condition is not true get a NULL marker
    that the following filter drops.  The result is the same rows.
    """
    marker = F.explode_outer(F.when(condition, F.array(F.lit(True))))
    return (df.select("*", marker.alias("_keep"))
            .filter(F.col("_keep").isNotNull()).drop("_keep"))
