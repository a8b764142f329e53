"""Registered queries of the corpus operators, with DuckDB SQL where SQL can
express them.  Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, exact_dedup, htmltext, mixing, pieces, private, quality, repeats, secrets, simhash, topk, warc,
               whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.measure(_table(spark, sf_dir, "documents")).drop("shards")


def piece_model() -> str:
    """The public 32k BPE model; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op2_pieces")
def op2_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    path = model_path or piece_model()
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), path, decoded=True)
    return encoded.select(
        "doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=400).drop("removed")


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id")))


@register("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


@register("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


@register("op7_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding,
             lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return htmltext.main_text(pages, htmltext.learn_weights(pages))


# Five hex digits of the SHA-1 make four base32 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + ((CAST('0x' || substr(sha1(h), {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)"
    for i in range(8) for shift in (15, 10, 5, 0))


@register("op9_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
           FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, warc.archive_pages(_table(spark, sf_dir, "pages")))


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def byte_vocabulary() -> str:
    """The public byte-level vocabulary; its place is a parameter of the
    operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str, byte_path: str | None = None,
                   piece_path: str | None = None) -> DataFrame:
    return alignment.link_counts(_table(spark, sf_dir, "documents"), byte_path or byte_vocabulary(),
                                 piece_path or piece_model())


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)


@register("op13_private")
def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_spans(_table(spark, sf_dir, "documents"))
