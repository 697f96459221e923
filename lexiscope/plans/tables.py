"""Driver tables and the stand-ins derived from them.

Stand-ins (all derived by Spark from the given tables, so the work grows with
them):

* corpus = ``documents(doc_id, text)``; ``doc_id`` is its positional index;
* queries = ``benchmark(item_id, text)``;
* judgments = documents containing a benchmark passage verbatim;
* question pairs = (text, next text of the same ``source`` by ``doc_id``);
* class labels = ``documents.source`` and ``embeddings.label``;
* dense vectors / token activations = ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.groups import next_in_group


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, question1, question2, is_duplicate)`` from consecutive documents of a source.

    Successors are found on ids alone; the texts join afterwards, at last by ``doc_id`` (the pair's ``pos``).
    """
    ids = next_in_group(table(spark, sf_dir, "documents", "doc_id", "source"), ["source"], "doc_id")
    # both sides deal the documents alike, so their texts move once for both
    left = table(spark, sf_dir, "documents", F.col("doc_id").alias("pos"), F.col("text").alias("question1"))
    right = table(spark, sf_dir, "documents", F.col("doc_id").alias("next_doc_id"), F.col("text").alias("question2"))
    ids = ids.filter(F.col("next_doc_id").isNotNull()).select(F.col("doc_id").alias("pos"), "next_doc_id")
    return (ids.join(right, "next_doc_id").join(left, "pos")
            .select("pos", "question1", "question2",
                    (F.col("question1") == F.col("question2")).cast("int").alias("is_duplicate")))


# ---- the same stand-ins in DuckDB SQL (oracle side) -------------------------

SQL_PAIRS = """
pairs AS (
  SELECT pos, question1, question2, CAST(question1 = question2 AS INTEGER) AS is_duplicate
  FROM (SELECT doc_id AS pos, text AS question1,
               lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS question2,
               lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt
        FROM documents) t
  WHERE nxt IS NOT NULL
)"""
