"""OP-38 (derived job): message-quality flags over a corpus of messages.

The original only *asks* the model for these properties (type prefix,
length, language, a one-to-two-sentence reason); here they become columns a
filter can use.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.js import non_ascii_units, utf16_length
from .history import ZH_SHARE
from .prompts import COMMIT_TYPES, MAX_MESSAGE_CHARS

CONVENTIONAL = r"\A(?:" + "|".join(COMMIT_TYPES) + r")(?:\([^()\r\n]*\))?: "
HAS_SCOPE = r"\A(?:" + "|".join(COMMIT_TYPES) + r")\([^()\r\n]*\): "
SENTENCE_END = r"[.!?\x{3002}\x{FF01}\x{FF1F}](?:\s|\z)"


def message_quality(df: DataFrame, message_col: str = "message",
                    reason_col: str | None = "reason") -> DataFrame:
    """Adds: chars (UTF-16 units), under_limit (< 72), conventional (type
    prefix, optional scope, then ': '), has_scope, language (zh / en by the
    same > 1/5 non-ASCII rule as author detection), and for reasons the
    sentence count and reason_ok (one or two sentences)."""
    m = F.col(message_col)
    num, den = ZH_SHARE
    chars = utf16_length(m)
    out = df.withColumns({
        "chars": chars.cast("int"),
        "under_limit": chars < MAX_MESSAGE_CHARS,
        "conventional": m.rlike(CONVENTIONAL),
        "has_scope": m.rlike(HAS_SCOPE),
        "language": F.when((chars > 0) & (non_ascii_units(m) * den > chars * num), F.lit("zh"))
        .otherwise(F.lit("en")),
    })
    if reason_col:
        n = F.regexp_count(F.col(reason_col), F.lit(SENTENCE_END))
        out = out.withColumns({"reason_sentences": n.cast("int"),
                               "reason_ok": (n >= 1) & (n <= 2)})
    return out
