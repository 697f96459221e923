"""lexiscope: text-vector retrieval, evaluation and clustering on Spark.

Every operator takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver except bounded, size-checked blocks (see README).
"""

from lexiscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
