"""Sampling, counting and row identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions.numeric import md5_order_key

_PREFIX_HEX = 4  # 16**4 = 65,536 order buckets


def sample_exact(df: DataFrame, key_col: str, frac: float, seed: int = 42,
                 rounding: str = "floor") -> DataFrame:
    """Exactly ``floor(frac*n)`` (or ``round``-half-even) rows, chosen by a seeded hash.

    Rows are ordered by ``md5(key || seed)``.  A histogram over the first hex
    digits (65,536 buckets) finds the bucket where the cumulative count reaches
    the target: buckets before it are kept whole, and only that one bucket is
    ordered to take the remainder.  No global sort, no single-task limit.
    """
    n = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    target = F.floor(n * F.lit(float(frac))) if rounding == "floor" else F.bround(n * F.lit(float(frac)), 0)
    target = target.cast("bigint")
    x = df.withColumn("_h", md5_order_key(key_col, seed)).withColumn("_p", F.substring("_h", 1, _PREFIX_HEX))
    hist = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select("_p", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    x = x.join(F.broadcast(hist), "_p")  # bounded: at most 65,536 rows
    whole = x.filter(F.col("_before") + F.col("_n") <= target)
    cross = x.filter((F.col("_before") < target) & (F.col("_before") + F.col("_n") > target))
    wr = Window.partitionBy("_p").orderBy("_h", key_col)
    cross = cross.withColumn("_r", F.row_number().over(wr)).filter(F.col("_before") + F.col("_r") <= target)
    return whole.select(*df.columns).unionByName(cross.select(*df.columns))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, count)`` like a value count (order is a presentation detail)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
