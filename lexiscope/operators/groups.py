"""Order-based operators that must not pin a whole group to one task.

Rows are dealt by ranges of the ordering key (sampled boundaries, so an
outlying key or a hot group does not fill one range), sorted inside each range
and written once with their place in it.  A position is the number of rows in
the ranges before (one number per range) plus that place: no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.operators.util import checkpointed

#: ``monotonically_increasing_id`` keeps the row's place in its partition in the lower 33 bits
_PLACE_BITS = 33


def dense_positions(df: DataFrame, pos_col: str = "doc_idx") -> DataFrame:
    """Dense 0-based positions in the present order of partitions and rows."""
    x = checkpointed(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE_BITS)
    counts = x.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (x.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(pos_col, (F.col("_off") + place).cast("bigint"))
            .select(*df.columns, pos_col))


def with_positions(df: DataFrame, key_cols: str | Sequence[str], pos_col: str = "doc_idx") -> DataFrame:
    """Dense 0-based positions in the order of the (unique) key."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return dense_positions(df.repartitionByRange(*keys).sortWithinPartitions(*keys), pos_col)


def next_in_group(df: DataFrame, group_cols: Sequence[str], order_col: str,
                  value_cols: Sequence[str] = (), prefix: str = "next_") -> DataFrame:
    """Add the values of the next row (by ``order_col``) in the same group.

    Equivalent to ``lead(v) over (partition by group order by order_col)`` for
    unique keys.  Adds ``{prefix}{order_col}`` and ``{prefix}{v}`` columns; they
    are NULL for the last row of a group.  Rows meet their successors by position.
    """
    groups, carried = list(group_cols), [order_col, *value_cols]
    x = with_positions(df, [*groups, order_col], "_pos")
    after = x.select((F.col("_pos") - 1).alias("_pos"), *[F.col(g).alias(f"_group_{g}") for g in groups],
                     *[F.col(c).alias(f"_after_{c}") for c in carried])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    return (x.join(after, "_pos", "left")
            .select(*df.columns, *[F.when(same, F.col(f"_after_{c}")).alias(f"{prefix}{c}") for c in carried]))
