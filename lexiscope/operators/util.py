"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar_count(df: DataFrame) -> "F.Column":
    """Row count of ``df`` as a scalar-subquery column (no driver round trip)."""
    return df.select(F.count(F.lit(1)).cast("bigint")).scalar()


_MATERIALIZE_MODE = {"mode": "parquet"}


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Default: a parquet table under ``<spark.checkpoint.dir>/tables/`` (the
    read-back has real size statistics for join planning and column
    pruning); ``set_materialize_mode("checkpoint")`` uses ``Dataset.checkpoint``
    instead.  Either way the lineage is cut and survives executor loss.
    """
    import uuid

    from lexiscope.session import checkpoint_dir, scratch_path

    spark = df.sparkSession
    checkpoint_dir(spark)
    if _MATERIALIZE_MODE["mode"] == "checkpoint":
        return df.checkpoint(eager=eager)
    path = scratch_path(spark, uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    rows._lexiscope_path = path
    return rows


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` once to the shared folder in buckets of ``key``: joins and groups on it leave these rows in place."""
    import uuid

    from lexiscope.session import scratch_path

    spark, name = df.sparkSession, f"lexiscope_{uuid.uuid4().hex}"
    (df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).option("compression", "zstd")
     .saveAsTable(name))
    rows = spark.table(name)
    rows.schema  # resolved here: the plan keeps the files and buckets
    spark.sql(f"DROP TABLE {name}")  # the entry goes; the files of a table with a path stay
    return rows


def released(spark, *tables: DataFrame) -> None:
    """Delete tables of ``checkpointed`` that nothing reads any more, and the shuffle files of plans out of use.

    Loops write anew in every step; without this the steps before stay on disk until the run ends.
    """
    from lexiscope.session import drop_shuffles, drop_table

    for path in {getattr(t, "_lexiscope_path", None) for t in tables} - {None}:
        drop_table(spark, path)
    drop_shuffles(spark)


def set_materialize_mode(mode: str) -> None:
    if mode not in ("parquet", "checkpoint"):
        raise ValueError(mode)
    _MATERIALIZE_MODE["mode"] = mode
