"""Round trips: given tables written in each input format and read back by the library's readers.

The oracle is the table itself, as the reader's rules leave it (ids as text, texts stripped).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lexiscope.plans import retrieval as R
from lexiscope.plans import tables
from lexiscope.plans.registry import register
from lexiscope.session import scratch_path
from lexiscope.sources.readers import read_collection, read_pairs, read_qrels, read_rootless_collection, read_topics
from lexiscope.sources.store import load_published_shards, write_shards_resumable

STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _folder(spark) -> str:
    return scratch_path(spark, f"roundtrip-{uuid4().hex}")


@register("roundtrip_collection", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {STRIPPED} AS text FROM documents")
def q_roundtrip_collection(spark, sf):
    path = _folder(spark)
    docs = tables.table(spark, sf, "documents", "doc_id", "text")
    (docs.select(F.col("doc_id").alias("docno"), "text").write.format("xml").option("rootTag", "collection")
     .option("rowTag", "doc").save(path))
    return read_collection(spark, path).select("doc_id", "text")


@register("roundtrip_rootless", f"SELECT CAST(item_id AS VARCHAR) AS doc_id, 'item ' || {STRIPPED} AS text FROM benchmark")
def q_roundtrip_rootless(spark, sf):
    path = _folder(spark)
    escaped = F.col("text")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    items = tables.table(spark, sf, "benchmark", "item_id", "text")
    items.select(F.concat(F.lit("<doc><docno> "), F.col("item_id").cast("string"), F.lit(" </docno><title>item</title><text>\n"),
                          escaped, F.lit("\n</text></doc>"))).write.text(path)
    return read_rootless_collection(spark, path).select("doc_id", "text")


@register("roundtrip_topics", f"SELECT CAST(item_id AS VARCHAR) AS query_id, {STRIPPED} AS query_text FROM benchmark")
def q_roundtrip_topics(spark, sf):
    path = _folder(spark)
    (tables.table(spark, sf, "benchmark", "item_id", "text")
     .select(F.col("item_id").alias("num"), F.concat(F.lit("\n "), "text", F.lit(" \n")).alias("title"))
     .write.format("xml").option("rootTag", "topics").option("rowTag", "top").save(path))
    return read_topics(spark, path)


@register("roundtrip_qrels", """
SELECT CAST(toxic AS VARCHAR) AS topic, CAST(0 AS INTEGER) AS iter, CAST(doc_id AS VARCHAR) AS docno,
       CAST(quality AS INTEGER) AS relevancy FROM labels""")
def q_roundtrip_qrels(spark, sf):
    path = _folder(spark)
    tables.table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        F.concat_ws("\t ", "toxic", F.lit("0"), "doc_id", "quality")).write.text(path)
    return read_qrels(spark, path)


@register("roundtrip_pairs", """
SELECT text AS question1, role AS question2, CAST(turn AS INTEGER) AS is_duplicate FROM conversations""")
def q_roundtrip_pairs(spark, sf):
    path = _folder(spark)
    (tables.table(spark, sf, "conversations", "text", "role", "turn")
     .select(F.col("text").alias("question1"), F.col("role").alias("question2"), F.col("turn").alias("is_duplicate"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_pairs(spark, path).select("question1", "question2", "is_duplicate")


@register("resumed_shards", "SELECT vec_id, CAST(label AS BIGINT) AS label, len(embedding) AS width FROM embeddings")
def q_resumed_shards(spark, sf):
    path = _folder(spark)
    vectors = tables.table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    for _ in range(2):  # the second call finds every part finished
        write_shards_resumable(vectors, path, "vec_id", parts=4)
    return load_published_shards(spark, path).select("vec_id", F.col("label").cast("bigint").alias("label"),
                                                     F.size("embedding").cast("bigint").alias("width"))


@register("stored_index", r"""
SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
GROUP BY doc_id, term""")
def q_stored_index(spark, sf):
    path, docs, queries = _folder(spark), tables.documents(spark, sf), tables.queries(spark, sf)
    R.word_index(docs, queries, store=path).doc_counts  # published
    counts = R.word_index(docs, queries, store=path).doc_counts  # read back
    return counts.toDF("doc_id", "term", "tf")
