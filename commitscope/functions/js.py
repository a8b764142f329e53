"""JavaScript string semantics as Spark column expressions.

The behaviour we reproduce was written against JavaScript strings and
regular expressions.  Java's regex engine and Spark's string functions
differ in small ways (what ``\\s`` and ``.`` match, where ``(?m)^`` matches,
whether replace is global, how long a string is).  These helpers close the
gaps with built-in expressions only, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's ``\s`` and ``String.prototype.trim``
# treat as white space (ECMAScript WhiteSpace + LineTerminator).
JS_WS_CHARS = (
    "\t\n\u000b\u000c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# The same set as a Java regex character class (Java's own ``\s`` is ASCII only).
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# JavaScript line terminators.  Java adds U+0085 to both ``.`` and ``(?m)^``;
# spelling the classes out keeps the JavaScript meaning.
LT = r"[\n\r\u2028\u2029]"
NOT_LT = r"[^\n\r\u2028\u2029]"
LINE_START = r"(?:\A|(?<=" + LT + r"))"
LINE_END = r"(?=" + LT + r"|\z)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """``s.trim()``: strip JavaScript white space on both ends (no regex)."""
    return F.btrim(_col(c), F.lit(JS_WS_CHARS))


def js_trim_end(c) -> Column:
    """``s.trimEnd()``.  The two-argument SQL ``rtrim`` takes (chars, str)."""
    return F.call_function("rtrim", F.lit(JS_WS_CHARS), _col(c))


def is_blank(c) -> Column:
    """True when the text is NULL or empty after ``trim()``."""
    col = _col(c)
    return col.isNull() | (F.length(js_trim(col)) == 0)


def utf16_length(c) -> Column:
    """``s.length``: UTF-16 code units; a code point above U+FFFF counts 2."""
    col = _col(c)
    return F.length(col) + F.regexp_count(col, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def non_ascii_units(c) -> Column:
    """Number of UTF-16 units outside 0x00-0x7F (``/[^\\x00-\\x7F]/g`` matches)."""
    col = _col(c)
    return (F.regexp_count(col, F.lit(r"[^\x00-\x7F]"))
            + F.regexp_count(col, F.lit(r"[\x{10000}-\x{10FFFF}]")))


def replace_first(c, pattern: str, replacement: str = "") -> Column:
    """``s.replace(/pattern/, replacement)``: replace the leftmost match only.

    ``regexp_replace`` is global.  ``split`` with limit 2 cuts at the
    leftmost match only, and joining the (at most two) pieces with the
    replacement gives the first-match replace in one regex scan.  The
    pattern must not match the empty string (``split`` drops a leading
    empty match) and ``replacement`` is literal text.
    """
    return F.array_join(F.split(_col(c), pattern, 2), replacement)


def starts_with_any(c, prefixes: list[str]) -> Column:
    col = _col(c)
    out = None
    for p in prefixes:
        cond = col.startswith(p)
        out = cond if out is None else (out | cond)
    return out


def round_half_up(c) -> Column:
    """``Math.round`` for non-negative values: floor(x + 0.5), never banker's."""
    return F.floor(_col(c) + F.lit(0.5))
