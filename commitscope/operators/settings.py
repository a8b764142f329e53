"""Options jobs (OP-20): stored options from partial updates, and the
effective options of every request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import DEFAULT_WIDTH, running_last

# The defaults of the two stored options.
DEFAULT_CONVENTIONAL = True
DEFAULT_LANGUAGE = "en"


def _last_set(col: str, seq: str = "seq") -> F.Column:
    """Last non-NULL value by ``seq`` (NULL in an update = leave alone).

    ``max_by`` skips rows whose ordering is NULL; it is a declarative
    aggregate, so it combines map-side.
    """
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(seq)))


def stored_settings(updates: DataFrame) -> DataFrame:
    """Fold partial updates (repo, seq, conventional, language) into the
    stored options per repo; a key an update leaves NULL keeps its value."""
    return updates.groupBy("repo").agg(_last_set("conventional").alias("stored_conventional"),
                                       _last_set("language").alias("stored_language"))


def resolve_settings(requests: DataFrame, stored: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """OP-20: effective options per request.

    ``requests``: repo, seq, kind ('regenerate' carries options, 'ready' does
    not), conventional, language, model, prompt; other columns pass through.

    * a regenerate request's own options win whole;
    * otherwise stored options (defaults where unset), with the session
      language over the stored language;
    * the session language is the language of the latest regenerate request
      at or before this one whose language is not ``auto``; an empty or
      missing language there counts as "no session language".
    """
    kind, lang = F.col("kind"), F.col("language")
    setter = F.when((kind == "regenerate") & (lang.isNull() | (lang != "auto")),
                    F.coalesce(lang, F.lit("")))
    df = running_last(requests.withColumn("_setter", setter), ["repo"], ["seq"], "_setter", "_session",
                      width=width)
    df = df.withColumn("session_language", F.nullif(F.col("_session"), F.lit(""))).drop("_setter", "_session")
    return _effective(df.join(stored, "repo", "left"), requests.columns)


def _effective(df: DataFrame, columns: list[str]) -> DataFrame:
    """A request's own options if it carries any, else the stored ones."""
    own = ("repo", "seq", "kind", "conventional", "language", "model", "prompt")
    regen = F.col("kind") == "regenerate"
    return df.select(
        "repo", "seq", "kind", *[c for c in columns if c not in own],
        F.when(regen, F.col("conventional"))
        .otherwise(F.coalesce("stored_conventional", F.lit(DEFAULT_CONVENTIONAL))).alias("conventional"),
        F.when(regen, F.col("language"))
        .otherwise(F.coalesce("session_language", "stored_language", F.lit(DEFAULT_LANGUAGE)))
        .alias("language"),
        F.when(regen, F.col("model")).alias("model"),
        F.when(regen, F.col("prompt")).alias("prompt"),
        "session_language",
    )


# ---------------------------------------------------------------------------
# Options as they were at a request
# ---------------------------------------------------------------------------

STATE = ["stored_conventional", "stored_language", "session_language"]


def option_timeline(updates: DataFrame, requests: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Versions of every repo's options: ``repo, valid_from, valid_to`` (NULL:
    still valid) and the whole state in between, one row per ``seq`` that
    changes something.

    ``updates`` and ``requests`` as in :func:`stored_settings` and
    :func:`resolve_settings`; ``seq`` orders both in one sequence, and what
    one ``seq`` holds becomes valid together.  Rows without repo or ``seq``
    give no version.  A reader of some span of ``seq`` needs the versions
    that overlap it and nothing older.
    """
    none = lambda kind: F.lit(None).cast(kind)
    spoken = requests.filter((F.col("kind") == "regenerate") & (F.col("language").isNull() | (F.col("language") != "auto")))
    events = (updates.select("repo", "seq", "conventional", "language", none("string").alias("session"))
              .unionByName(spoken.select("repo", "seq", none("boolean").alias("conventional"),
                                         none("string").alias("language"),
                                         F.coalesce("language", F.lit("")).alias("session")))
              .filter(F.col("repo").isNotNull() & F.col("seq").isNotNull()))
    versions = events.groupBy("repo", "seq").agg(*[F.max(c).alias(c) for c in ("conventional", "language", "session")])
    versions = versions.filter(F.coalesce(F.col("conventional").cast("string"), "language", "session").isNotNull())
    for value, out in zip(("conventional", "language", "session"), STATE):
        versions = running_last(versions, ["repo"], ["seq"], value, out, width=width)
    versions = running_last(versions.withColumn("_from", F.col("seq")), ["repo"], ["seq"], "_from", "valid_to",
                            width=width, inclusive=False, reverse=True)
    return versions.select("repo", F.col("seq").alias("valid_from"), "valid_to", *STATE[:2],
                           F.nullif(F.col(STATE[2]), F.lit("")).alias(STATE[2]))


def settings_as_of(requests: DataFrame, timeline: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Effective options per request (columns of :func:`resolve_settings`),
    from the version valid at the request's ``seq``, its own included.

    An as-of join without pairs: versions and requests are one sequence per
    repo, and each request takes the last version before it from a bucketed
    scan, so a repo with a third of all rows spreads over its buckets.
    Requests before the first version, or without repo, get the defaults.
    """
    columns = requests.columns
    state, asked = F.struct(*STATE), F.struct(*[F.col(c) for c in columns])
    nothing = requests.sparkSession.createDataFrame([], timeline.schema).select(state.alias("s")).schema["s"].dataType
    points = timeline.select("repo", F.col("valid_from").alias("seq"), F.lit(0).alias("_rank"), state.alias("_state"),
                             F.lit(None).cast(requests.select(asked.alias("r")).schema["r"].dataType).alias("_asked"))
    points = points.unionByName(requests.select("repo", "seq", F.lit(1).alias("_rank"),
                                                F.lit(None).cast(nothing).alias("_state"), asked.alias("_asked")))
    found = running_last(points, ["repo"], ["seq", "_rank"], "_state", "_valid", width=width)
    found = found.filter(F.col("_asked").isNotNull())
    return _effective(found.select("_asked.*", *[F.col(f"_valid.{c}").alias(c) for c in STATE]), columns)
