"""Inference jobs: choose a model per request (OP-23) and run a caller's
function over prompts in Arrow batches (OP-24)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# The preferred vendor and family of the fallback tiers.
FALLBACK_VENDOR = "copilot"
FALLBACK_FAMILY = "gpt-4o"
NO_MODEL_ERROR = "no language model available"


def _first(cond, pos="cat_pos") -> F.Column:
    """The (id, name) of the first listed model meeting ``cond`` (NULL if none).
    ``min_by`` skips rows whose ordering is NULL."""
    return F.min_by(F.struct("id", "name"), F.when(cond, F.col(pos)) if cond is not None else F.col(pos))


def assign_model(requests: DataFrame, models: DataFrame, preferred_col: str = "model",
                 catalog_col: str = "catalog_id", vendor: str = FALLBACK_VENDOR,
                 family: str = FALLBACK_FAMILY) -> DataFrame:
    """OP-23: tiered choice per request.

    1. the preferred id, tried only when non-empty;
    2. the first model of ``vendor`` + ``family``;
    3. the first model of ``vendor``;
    4. the first model at all;
    else an error row.  Within a tier the first listed (``cat_pos``) wins; the
    display name falls back to the id when blank.

    No request is paired with the whole catalogue: tier 1 is an equi-join on
    (catalogue, id) and tiers 2-4 are one aggregate row per catalogue joined
    on the catalogue key.
    """
    v, f = F.col("vendor"), F.col("family")
    by_id = (models.groupBy(catalog_col, "id")
             .agg(F.min_by("name", "cat_pos").alias("_t1_name"))
             .withColumnRenamed("id", "_t1_id"))
    fallbacks = (models.groupBy(catalog_col)
                 .agg(_first((v == vendor) & (f == family)).alias("_t2"),
                      _first(v == vendor).alias("_t3"),
                      _first(None).alias("_t4")))
    pref = F.col(preferred_col)
    req = requests.withColumn("_pref", F.when(F.length(F.coalesce(pref, F.lit(""))) > 0, pref))
    joined = (req.join(by_id, (req[catalog_col] == by_id[catalog_col]) & (req["_pref"] == by_id["_t1_id"]),
                       "left").drop(by_id[catalog_col])
              .join(fallbacks, catalog_col, "left"))
    t1 = F.when(F.col("_t1_id").isNotNull(), F.struct(F.col("_t1_id").alias("id"),
                                                      F.col("_t1_name").alias("name")))
    chosen = F.coalesce(t1, F.col("_t2"), F.col("_t3"), F.col("_t4"))
    tier = (F.when(t1.isNotNull(), F.lit(1)).when(F.col("_t2").isNotNull(), F.lit(2))
            .when(F.col("_t3").isNotNull(), F.lit(3)).when(F.col("_t4").isNotNull(), F.lit(4)))
    name = F.coalesce(F.nullif(chosen["name"], F.lit("")), chosen["id"])
    return (joined.withColumns({
        "model_id": chosen["id"], "model_name": name, "tier": tier,
        "error": F.when(chosen.isNull(), F.lit(NO_MODEL_ERROR)),
    }).drop("_pref", "_t1_id", "_t1_name", "_t2", "_t3", "_t4"))


# ---------------------------------------------------------------------------
# OP-24: batch inference
# ---------------------------------------------------------------------------

InferFn = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def _slices(prompts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """``(start, count)`` of runs of at most ``rows`` prompts; a run ends once
    it holds ``size`` bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(prompts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(upto):
        full = int(np.searchsorted(upto, before + size)) + 1
        end = min(start + rows, max(full, start + 1), len(upto))
        yield start, end - start
        start, before = end, int(upto[end - 1])


def _strings(values: list, kind: pa.DataType) -> pa.Array:
    """A string column of a caller's values (other types as their text)."""
    series = pd.Series(values, dtype=object)
    try:
        return pa.Array.from_pandas(series, type=kind)
    except pa.ArrowException:
        return pa.Array.from_pandas(series).cast(kind)


def infer(prompts: DataFrame, fn: InferFn, prompt_col: str = "prompt_text",
          keys: list[str] | None = None, slice_rows: int = 64, slice_bytes: int = 4 << 20) -> DataFrame:
    """Run ``fn`` (an iterator of prompt batches -> iterator of answer batches)
    over every prompt with ``mapInArrow``: one call per task, so a client can
    be built once, fed slices of at most ``slice_rows`` prompts (and no more
    than ``slice_bytes`` before the last one).

    Only the prompts of a slice become Python strings; keys and the rest of a
    batch stay in its Arrow buffers, so what a worker holds doesn't grow with
    its task's rows.

    Rows whose prompt is NULL pass through (raw and error NULL) without
    reaching ``fn``.  When ``fn`` fails, ends early or returns a wrong number
    of answers, the prompts of the slices it had taken and not answered are
    asked again one by one, so a bad prompt costs its own row only (``raw``
    NULL and the error's whole text); ``fn`` is then called afresh for the
    rest of the task.
    Output: keys..., raw STRING, infer_error STRING.
    """
    ship_package(prompts.sparkSession)
    keys = keys if keys is not None else [c for c in prompts.columns if c != prompt_col]
    src = prompts.select(*keys, prompt_col)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in src.schema.fields if f.name in keys)
    schema = (key_schema + ", " if key_schema else "") + "raw string, infer_error string"

    def rows(part: pa.RecordBatch, raw: list, err: list) -> pa.RecordBatch:
        kind = part.column(prompt_col).type
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), _strings(raw, kind), _strings(err, kind)],
                                          names=[*keys, "raw", "infer_error"])

    def texts(part: pa.RecordBatch) -> pd.Series:
        return pd.Series(part.column(prompt_col).to_pylist(), dtype=object)

    def ask_one(prompt: str) -> tuple[str | None, str | None]:
        try:
            got = [a for answers in fn(iter([pd.Series([prompt], dtype=object)])) for a in answers]
            if len(got) == 1:
                return _strings(got, pa.string())[0].as_py(), None
        except Exception as e:  # noqa: BLE001 - the error becomes data
            return None, f"{type(e).__name__}: {e}".encode("utf-8", "replace").decode()
        return None, f"answer count {len(got)} != prompt count 1"

    def answered(part: pa.RecordBatch, answers: list) -> pa.RecordBatch:
        if len(answers) == len(part):
            try:
                return rows(part, answers, [None] * len(part))
            except (pa.ArrowException, ValueError, TypeError):
                pass  # some answer is no text
        return one_by_one(part)

    def one_by_one(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, err = zip(*map(ask_one, texts(part)))
        return rows(part, list(raw), list(err))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []  # pass-through rows
        taken: list[pa.RecordBatch] = []  # slices handed over and not answered

        def slices() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in _slices(b.column(prompt_col), slice_rows, slice_bytes):
                    part = b.slice(*at)
                    if part.column(prompt_col).null_count:
                        missing = part.filter(pc.is_null(part.column(prompt_col)))
                        done.append(rows(missing, [None] * len(missing), [None] * len(missing)))
                        part = part.filter(pc.is_valid(part.column(prompt_col)))
                    if len(part):
                        yield part

        rest = slices()
        fed = 0

        def feed() -> Iterator[pd.Series]:
            nonlocal fed
            for part in rest:
                fed += 1
                taken.append(part)
                yield texts(part)

        while True:
            before = fed
            try:
                for answers in fn(feed()):
                    answers = list(answers)
                    if not taken:
                        break  # more answers than prompts
                    part = taken.pop(0)
                    yield answered(part, answers)
                    while done:
                        yield done.pop(0)
            except Exception:  # noqa: BLE001 - found out prompt by prompt below
                pass
            if fed == before:
                part = next(rest, None)  # fn took nothing: go on prompt by prompt
                if part is None:
                    break
                taken.append(part)
            while taken:
                yield one_by_one(taken.pop(0))
        while done:
            yield done.pop(0)

    return src.mapInArrow(run, schema)
