"""Response jobs: reassemble chunked answers (OP-25), strip code fences
(OP-26), parse answers strictly (OP-27), dead letters (OP-28), and build
commit candidates (OP-29)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.js import LINE_END, LINE_START, WS, js_trim, replace_first
from ..session import ship_package

ERROR_HEAD_UNITS = 300  # UTF-16 units of the raw answer kept in an error
ITEMS_SCHEMA = "array<struct<message:string,reason:string>>"


# ---------------------------------------------------------------------------
# OP-25
# ---------------------------------------------------------------------------

def assemble_chunks(chunks: DataFrame, key: str = "request_id") -> DataFrame:
    """Concatenate chunks in ``idx`` order per request (arrival order does not
    matter).  The collect holds one answer, i.e. one model output, so it is
    bounded by the model's output size, not by the data."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "chunk")))
    return (chunks.groupBy(key)
            .agg(F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("raw"),
                 F.count(F.lit(1)).alias("chunks"),
                 F.max(F.col("is_last").cast("int")).cast("boolean").alias("complete")))


# ---------------------------------------------------------------------------
# OP-26
# ---------------------------------------------------------------------------

def strip_fences(raw) -> Column:
    """Remove the first opening fence line (three backticks, optional
    ``json``, following white space) and the first closing fence (white
    space, three backticks, white space up to a line end), then trim.
    Both replaces are first-match only."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    opened = replace_first(raw, LINE_START + r"```(?:json)?" + WS + "*")
    closed = replace_first(opened, WS + r"*```" + WS + "*" + LINE_END)
    return js_trim(closed)


# ---------------------------------------------------------------------------
# OP-27: strict parsing (the one Python stage besides the model call)
# ---------------------------------------------------------------------------

def _reject_constant(name: str):
    raise ValueError(f"not JSON: {name}")


def _js_json(text: str):
    """``JSON.parse``: no NaN/Infinity, no trailing text, last duplicate key
    wins, raw control characters rejected (``json.loads`` strict mode)."""
    return json.loads(text, parse_constant=_reject_constant, parse_int=float)


def _clean(s: str) -> str:
    """Lone surrogates (legal in JSON escapes) cannot cross Arrow: replace."""
    if not isinstance(s, str):
        return s
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _is_pair(item) -> bool:
    return isinstance(item, dict) and isinstance(item.get("message"), str) \
        and isinstance(item.get("reason"), str)


def _head(raw: str) -> str:
    units = raw.encode("utf-16-le", "surrogatepass")[:2 * ERROR_HEAD_UNITS]
    return units.decode("utf-16-le", "replace")


def _try(text: str, ok):
    try:
        value = _js_json(text)
    except (ValueError, RecursionError):
        return None
    return value if ok(value) else None


def _parse_one(cleaned: str, opener: str, closer: str, ok):
    got = _try(cleaned, ok)
    if got is not None:
        return got
    i, j = cleaned.find(opener), cleaned.rfind(closer)
    if i != -1 and j > i:
        return _try(cleaned[i:j + 1], ok)
    return None


_OBJ_TYPE = StructType([StructField(n, StringType()) for n in ("message", "reason", "error")])
_ARR_TYPE = StructType([StructField(n, StringType()) for n in ("items_json", "error")])


@pandas_udf(_OBJ_TYPE)
def _parse_object_udf(cleaned: pd.Series, raw: pd.Series) -> pd.DataFrame:
    msgs, reasons, errors = [], [], []
    for c, r in zip(cleaned, raw):
        got = None if c is None else _parse_one(c, "{", "}", _is_pair)
        if got is None:
            msgs.append(None)
            reasons.append(None)
            errors.append("unparsable response: " + _head(r or ""))
        else:
            msgs.append(_clean(got["message"]))
            reasons.append(_clean(got["reason"]))
            errors.append(None)
    return pd.DataFrame({"message": msgs, "reason": reasons, "error": errors})


@pandas_udf(_ARR_TYPE)
def _parse_array_udf(cleaned: pd.Series, raw: pd.Series, expected: pd.Series) -> pd.DataFrame:
    items, errors = [], []
    for c, r, n in zip(cleaned, raw, expected):
        def ok(v, n=n):
            return isinstance(v, list) and n is not None and len(v) == int(n) \
                and all(_is_pair(x) for x in v)
        got = None if c is None else _parse_one(c, "[", "]", ok)
        if got is None:
            items.append(None)
            errors.append(f"unparsable response (expected array of {n}): " + _head(r or ""))
        else:
            canon = [{"message": _clean(x["message"]), "reason": _clean(x["reason"])} for x in got]
            items.append(json.dumps(canon, ensure_ascii=False))
            errors.append(None)
    return pd.DataFrame({"items_json": items, "error": errors})


def _once(value: Column) -> Column:
    """A generator of one row: filters on its fields stay above it, so the
    Python stage below is planned once."""
    return F.explode_outer(F.array(value))


def parse_object(responses: DataFrame, raw_col: str = "raw") -> DataFrame:
    """OP-27 (object form): adds ``message``, ``reason`` (NULL on failure)
    and ``error``.  Fence stripping and trimming run in the JVM first."""
    ship_package(responses.sparkSession)
    parsed = _once(_parse_object_udf(strip_fences(raw_col), F.col(raw_col)))
    return responses.select("*", parsed.alias("_p")).select("*", "_p.*").drop("_p")


def parse_array(responses: DataFrame, expected_col: str, raw_col: str = "raw") -> DataFrame:
    """OP-27 (array form): adds ``items`` ARRAY<STRUCT<message, reason>> of
    exactly ``expected`` elements, or NULL and ``error``.

    The UDF only validates and re-serialises canonical JSON; Spark's
    ``from_json`` then builds the array (the text is ours, so its leniency
    does not matter)."""
    ship_package(responses.sparkSession)
    parsed = _parse_array_udf(strip_fences(raw_col), F.col(raw_col), F.col(expected_col).cast("long"))
    return (responses.select("*", _once(parsed).alias("_p"))
            .withColumn("items", F.from_json(F.col("_p.items_json"), ITEMS_SCHEMA))
            .withColumn("error", F.col("_p.error")).drop("_p"))


# ---------------------------------------------------------------------------
# OP-28 / OP-29
# ---------------------------------------------------------------------------

def response_errors(parsed: DataFrame, keys: list[str], cancelled: DataFrame | None = None) -> DataFrame:
    """OP-28: dead letters: one row per failed answer with the error (which
    holds the first 300 UTF-16 units of the raw text).  Answers of runs in
    ``cancelled`` (rows of ``keys``) are not errors and are left out."""
    errors = parsed.filter(F.col("error").isNotNull()).select(*keys, "error")
    if cancelled is not None:
        errors = errors.join(cancelled.select(*keys).distinct(), keys, "left_anti")
    return errors


def build_candidates_in_row(parsed: DataFrame, keys: list[str], group_files_col: str = "group_files",
                            generation_col: str | None = None) -> DataFrame:
    """OP-29: the i-th answer item belongs to the i-th group.

    The answer row still carries its snapshot's file lists (``group_files``:
    ARRAY<ARRAY<STRING>> in group order), so items and groups are zipped by
    position inside the row, no join.  message/reason are trimmed, candidates
    start checked, and the id is a hash of (keys, generation, group_ord), so
    re-runs give the same id."""
    gen = [generation_col] if generation_col else []
    zipped = F.transform(F.col("items"), lambda it, i: F.struct(
        i.alias("group_ord"), it["message"].alias("message"), it["reason"].alias("reason"),
        F.element_at(F.col(group_files_col), i + 1).alias("files")))
    rows = (parsed.filter(F.col("items").isNotNull())
            .select(*keys, *gen, F.explode_outer(zipped).alias("c")).filter(F.col("c").isNotNull())
            .select(*keys, *gen, "c.*"))
    id_parts = [F.col(k).cast("string") for k in keys + gen] + [F.col("group_ord").cast("string")]
    return rows.select(
        *keys, *gen, "group_ord",
        F.sha2(F.concat_ws("|", *id_parts), 256).alias("candidate_id"),
        js_trim(F.col("message")).alias("message"), js_trim(F.col("reason")).alias("reason"),
        "files", F.lit(True).alias("checked"))
