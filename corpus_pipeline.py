"""From raw documents to packed training sequences, one operator after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet and read back before the next stage works on all of it.
All but the last return the columns of ``documents``.  A stage deletes the
intermediate tables of the stages before it, as their results are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiscope.llm.common import stored, table
from lexiscope.llm.decontaminate import decontamination_stage
from lexiscope.llm.packing import packing_stage
from lexiscope.llm.quality import quality_stage
from lexiscope.llm.simhash import simhash_stage
from lexiscope.llm.suffix_dedup import suffix_stage
from lexiscope.session import begin_scope, end_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _scoped(name: str, stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_scope(spark, name, docs)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            end_scope(spark)
    return run_stage


STAGES = [(name, _scoped(name, stage)) for name, stage in (
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
)]

#: fingerprints, suffix arrays and tokens have no SQL; the tests hold the run against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``: one row per packed piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        docs = done if name == STAGES[-1][0] else stored(done)
    return docs
