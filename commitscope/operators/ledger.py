"""Resumable inference (OP-24/39): answers are kept by a digest of model and
prompt, so equal prompts are asked once and a run that broke goes on where it
stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inference import InferFn, infer

DIGEST = "_digest"
SCHEMA = f"{DIGEST} string, raw string, infer_error string, run long"
BINS_PER_TASK = 64


def prompt_digest(prompt, model):
    """Digest of a model id and a prompt (neither can run into the other)."""
    model = F.coalesce(model, F.lit(""))
    return F.sha2(F.concat(F.length(model).cast("string"), F.lit(":"), model, prompt), 256)


def balanced(prompts: DataFrame, tasks: int, prompt_col: str = "prompt_text") -> DataFrame:
    """``prompts`` in ``tasks`` partitions of about equal length.

    Prompts fall into many bins by hash; the bins' lengths (at most
    ``BINS_PER_TASK`` rows a task) are summed up in order, and each task gets
    the bins whose middle falls into its share of the whole.
    """
    bins = BINS_PER_TASK * tasks
    binned = prompts.withColumn("_bin", F.pmod(F.xxhash64(prompt_col), F.lit(bins)))
    sizes = binned.groupBy("_bin").agg(F.sum(F.length(prompt_col) + 1).alias("_size"))
    all_bins = Window.partitionBy(F.lit(0))
    upto = F.sum("_size").over(all_bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    share = (upto - F.col("_size") / 2) / F.sum("_size").over(all_bins)
    dealt = sizes.select("_bin", F.least(F.floor(share * tasks), F.lit(tasks - 1)).cast("int").alias("_task"))
    return binned.join(F.broadcast(dealt), "_bin").repartitionById(tasks, "_task").drop("_bin", "_task")


class AnswerLedger:
    """A table of answers under ``path`` (a folder that all executors share).

    ``ask`` writes what it gets wave by wave; each wave is committed as a
    whole, so a break loses the answers of one wave at most.  Failed prompts
    are kept with their error and asked again by the next run.
    """

    def __init__(self, spark: SparkSession, path: str, waves: int = 16):
        self.spark, self.path, self.waves = spark, path.rstrip("/"), waves
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(f"{self.path}/answers")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/answers")

    def answered(self) -> DataFrame:
        """The digests that have an answer."""
        return self._rows().filter(F.col("infer_error").isNull()).select(DIGEST).distinct()

    def answers(self) -> DataFrame:
        """One row per digest: its answer, else its newest error."""
        order = F.struct(F.col("infer_error").isNull(), "run")
        return (self._rows().groupBy(DIGEST).agg(F.max_by(F.struct("raw", "infer_error"), order).alias("_a"))
                .select(DIGEST, "_a.raw", "_a.infer_error"))

    def ask(self, prompts: DataFrame, fn: InferFn, prompt_col: str = "prompt_text", model_col: str = "model_id",
            tasks: int | None = None) -> DataFrame:
        """``prompts`` with ``raw`` and ``infer_error`` (both NULL where the
        prompt is NULL), asking only what has no answer yet and equal prompts
        of a model once.  ``prompts`` is read twice: pass a written table."""
        tasks = tasks or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = prompts.withColumn(DIGEST, prompt_digest(F.col(prompt_col), F.col(model_col)))
        wanted = keyed.filter(F.col(prompt_col).isNotNull()).select(DIGEST, F.col(prompt_col).alias("prompt_text"))
        missing = wanted.dropDuplicates([DIGEST]).join(self.answered(), DIGEST, "left_anti")
        todo = f"{self.path}/todo-{uuid.uuid4().hex}"
        (missing.repartition(self.waves * tasks, DIGEST).withColumn("wave", F.spark_partition_id() % self.waves)
         .write.partitionBy("wave").parquet(todo))
        run = 1 + (self._rows().agg(F.max("run")).first()[0] or 0)
        open_ = self.spark.read.schema(f"{DIGEST} string, prompt_text string, wave int").parquet(todo)
        for wave in [r.wave for r in open_.select("wave").distinct().orderBy("wave").collect()]:  # ``waves`` rows
            self._ask_wave(open_.filter(F.col("wave") == wave).drop("wave"), fn, run, tasks)
        return keyed.join(self.answers(), DIGEST, "left").drop(DIGEST, prompt_col)

    def _ask_wave(self, prompts: DataFrame, fn: InferFn, run: int, tasks: int) -> None:
        got = infer(balanced(prompts, tasks), fn, keys=[DIGEST])
        got.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{self.path}/answers")
