"""Column-expression helpers shared by the operators."""

from .frames import keep_where
from .js import (JS_WS_CHARS, LINE_END, LINE_START, LT, NOT_LT, WS, is_blank, js_trim,
                 js_trim_end, non_ascii_units, replace_first, round_half_up, starts_with_any,
                 utf16_length)

__all__ = [
    "JS_WS_CHARS", "LINE_END", "LINE_START", "LT", "NOT_LT", "WS", "is_blank", "js_trim",
    "js_trim_end", "non_ascii_units", "replace_first", "round_half_up", "starts_with_any",
    "utf16_length", "keep_where",
]
