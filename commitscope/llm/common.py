"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark
    compares names without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


class Workspace:
    """One folder per run under the shared checkpoint folder.

    ``stage`` writes a DataFrame there as Parquet and reads it back: lineage
    ends at files that every executor can reach, and what was computed is
    computed once.  Folders stay until the operator of the cluster empties
    the checkpoint folder, since lazily evaluated results read them.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
        ship_package(spark)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def one_row_each(rows: DataFrame, keys: list[str], tied: Column, any_tied: bool) -> DataFrame:
    """``rows`` with one row left of every group of ``tied`` rows with equal
    ``keys``; rows that aren't ``tied`` pass through.

    The aggregate combines map-side, so a row repeated without bound still
    reaches its task as one row per input task.  ``any_tied`` is what the
    caller found in the (small) key table; without ties nothing is shuffled.
    """
    if not any_tied:
        return rows
    return rows.filter(~tied).unionByName(rows.filter(tied).dropDuplicates(keys))
