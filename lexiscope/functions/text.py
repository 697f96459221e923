"""Text expressions.

Fixed values (they define the token semantics and must stay as they are):
a token is a maximal run of at least two Unicode letters, digits or
underscores, taken from the lower-cased text.  ``\\p{L}``/``\\p{N}`` are
spelled out because ``\\w`` is ASCII-only in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the word-token pattern (runs of >= 2 letters/digits/underscore).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, min_len: int = 2) -> Column:
    """array<string> of word tokens of ``lower(text)`` in text order."""
    pattern = TOKEN_PATTERN if min_len == 2 else r"[\p{L}\p{N}_]{%d,}" % min_len
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), 0)


def strip_text(text) -> Column:
    """Strip leading/trailing whitespace including newlines (Python ``str.strip``)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def strip_bom(text) -> Column:
    """Drop a leading byte-order mark, then leading whitespace."""
    return F.regexp_replace(_c(text), "^\\uFEFF?\\s*", "")


def nonblank(text) -> Column:
    """Stripped text, or NULL when nothing is left (an empty XML child)."""
    s = strip_text(text)
    return F.when(F.length(s) > 0, s)


def snippet(text, max_chars: int = 500, suffix: str = "...") -> Column:
    """First ``max_chars`` characters, plus ``suffix`` only when the text was longer."""
    t = _c(text)
    return (F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(suffix)))
            .otherwise(t))
