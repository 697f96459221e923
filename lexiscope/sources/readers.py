"""Readers for the input formats: XML collections and topics, whitespace
judgments, question-pair CSV, labelled corpora and JSON arrays.

Schemas are always explicit: inferred XML would type numeric ids as bigint,
while ids are compared as strings.  XML reads fail fast on a malformed
record instead of silently producing NULL rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.functions.text import strip_bom, strip_text


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def with_load_order(df: DataFrame, idx_col: str = "doc_idx") -> DataFrame:
    """Dense 0-based positions in file order (the reader's row order); the file is parsed once."""
    from lexiscope.operators.groups import dense_positions

    return dense_positions(df, idx_col)


def read_collection(spark: SparkSession, path: str, id_tag: str = "docno",
                    text_tag: str = "text", row_tag: str = "doc") -> DataFrame:
    """A rooted XML collection: each ``<doc>`` -> ``(doc_id, doc_idx, text)``.

    Id and text are stripped; other children (title, genre, ...) are not
    read (the schema prunes them).  ``doc_idx`` is the position in the file.
    """
    df = (spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST")
          .schema(_strings(id_tag, text_tag)).load(path))
    out = df.select(strip_text(id_tag).alias("doc_id"), strip_text(text_tag).alias("text"))
    return with_load_order(out).select("doc_id", "doc_idx", "text")


def read_rootless_collection(spark: SparkSession, path: str, text_tags: Sequence[str] | None = None,
                             id_tag: str = "docno", row_tag: str = "doc") -> DataFrame:
    """A file that is a bare concatenation of ``<doc>`` records (no root element).

    Records are split on the closing tag (splittable text source); the opening
    tag may have attributes.  ``text`` = blank-join of the stripped non-empty
    texts of all children but the id, in document order, repeated children
    included (or of the children named in ``text_tags`` only).  A leading BOM
    or blank lines are tolerated; a malformed record fails the read.
    """
    close = f"</{row_tag}>"
    wanted = f"not(self::{id_tag})"
    if text_tags is not None:
        wanted += " and (" + " or ".join(f"self::{t}" for t in text_tags) + ")" if text_tags else " and false()"
    rec = (spark.read.option("lineSep", close).text(path)
           .select(F.regexp_extract("value", rf"(?s)<{row_tag}(?:\s[^>]*)?>.*", 0).alias("rec"))
           .filter(F.col("rec") != "").select(F.concat("rec", F.lit(close)).alias("rec")))
    # a child's own text stands before its first element
    texts = F.xpath("rec", F.lit(f"/{row_tag}/*[{wanted}]/text()[not(preceding-sibling::*)]"))
    parsed = rec.select(F.xpath_string("rec", F.lit(f"/{row_tag}/{id_tag}")).alias(id_tag), texts.alias("texts"))
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    out = parsed.select(strip_text(id_tag).alias("doc_id"),
                        F.concat_ws(" ", F.filter(F.transform("texts", strip), lambda t: t != "")).alias("text"))
    return with_load_order(out).select("doc_id", "doc_idx", "text")


def read_topics(spark: SparkSession, path: str, id_tag: str = "num", text_tag: str = "title",
                row_tag: str = "top") -> DataFrame:
    """Topic file: each ``<top>`` -> ``(query_id, query_text)``; multi-line titles stripped."""
    df = (spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST")
          .schema(_strings(id_tag, text_tag)).load(path))
    return df.select(strip_text(id_tag).alias("query_id"), strip_text(text_tag).alias("query_text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-delimited judgments ``topic iter docno relevancy`` (no header)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (spark.read.text(path).filter(F.length(F.trim("value")) > 0)
            .select(parts[0].alias("topic"), parts[1].cast("int").alias("iter"),
                    parts[2].alias("docno"), parts[3].cast("int").alias("relevancy")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Question-pair CSV with a header; only ``question1, question2, is_duplicate`` are used.

    ``pos`` keeps the file order (ordered, not dense; see ``with_positions``).
    """
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("inferSchema", False).csv(path))
    return df.select(F.monotonically_increasing_id().alias("pos"), "question1", "question2",
                     F.col("is_duplicate").cast("int").alias("is_duplicate"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled corpus stored as parquet ``(doc_id, text, label)``."""
    return spark.read.parquet(path).select("doc_id", "text", F.col("label").cast("int"))


def read_json_array(spark: SparkSession, path: str, fields: Sequence[str] = ("figure", "text")) -> DataFrame:
    """A JSON file holding one array of flat objects."""
    return spark.read.option("multiLine", True).schema(_strings(*fields)).json(path)


def clean_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop a leading BOM, then leading whitespace."""
    return df.withColumn(col, strip_bom(col))
