"""Column-level expressions (all JVM-side built-ins, codegen friendly)."""

from lexiscope.functions.text import (
    TOKEN_PATTERN, tokens, strip_text, strip_bom, snippet, nonblank,
)
from lexiscope.functions.numeric import (
    smooth_idf, rounded, safe_divide, argmax_index, l1_normalize_array,
    md5_order_key, pair_count,
)

__all__ = [
    "TOKEN_PATTERN", "tokens", "strip_text", "strip_bom", "snippet", "nonblank",
    "smooth_idf", "rounded", "safe_divide", "argmax_index", "l1_normalize_array",
    "md5_order_key", "pair_count",
]
