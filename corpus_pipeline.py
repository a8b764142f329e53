"""From raw documents to mixed, encoded training rows, in five stages.

``STAGES`` lists ``(name, function)``; each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm import exact_dedup, mixing, pieces, quality, simhash
from commitscope.llm.common import Workspace
from commitscope.llm.queries import piece_model

SHINGLE, RADIUS = 3, 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learned from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one row of each component stays."""
    return simhash.drop_near(docs, shingle=SHINGLE, radius=RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for each time a document is taken."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row, and the digest of their decoded text."""
    encoded = pieces.encode(docs, piece_model(), decoded=True)
    return encoded.select(
        "doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("simhash", drop_near), ("mixing", mix_sources),
          ("pieces", encode_pieces)]

# The classifier, the fingerprints, the draws and the pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
