"""Numeric expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def smooth_idf(df_col, n_col) -> Column:
    """Smoothed inverse document frequency ``ln((1+n)/(1+df)) + 1``."""
    return F.log((F.lit(1.0) + _c(n_col)) / (F.lit(1.0) + _c(df_col))) + F.lit(1.0)


def rounded(c, digits: int = 6) -> Column:
    """Round a double for display/comparison (metric formatting)."""
    return F.round(_c(c).cast("double"), digits)


def safe_divide(num, den) -> Column:
    """num / den, 0.0 when the denominator is 0 or NULL."""
    return F.coalesce(_c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0)), F.lit(0.0))


def argmax_index(arr) -> Column:
    """0-based index of the first maximum of an array (first max wins)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def l1_normalize_array(arr) -> Column:
    """Divide each element by the sum of absolute values; a zero row stays zero."""
    a = _c(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return F.when(total > 0, F.transform(a, lambda x: x / total)).otherwise(
        F.transform(a, lambda x: F.lit(0.0)))


def md5_order_key(key, seed) -> Column:
    """Deterministic pseudo-random order key: md5 of ``cast(key as string) || seed``."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit(str(seed))))


def pair_count(n) -> Column:
    """n*(n-1)/2 as double (number of unordered pairs)."""
    x = _c(n).cast("double")
    return x * (x - F.lit(1.0)) / F.lit(2.0)
