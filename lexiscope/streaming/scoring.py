"""Score queries that arrive as files against a fitted word index.

The index (idf table and L2 document vectors) is fitted once in batch and
written to shared storage; each micro-batch of new queries is tokenised,
weighted with the fitted idf (learned vocabulary), scored by the sparse
inverted-index join and ranked - the same operators as the batch plan.
``foreachBatch`` and a checkpoint location resume a stopped query where it was;
the sink appends, so a batch that is retried may repeat its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.operators.ranking import rank_docs
from lexiscope.operators.similarity import cosine_sparse
from lexiscope.operators.tokens import term_counts, tokenize
from lexiscope.operators.weights import tfidf

QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query_text", T.StringType()),
])


def rank_batch(batch: DataFrame, idf: DataFrame, doc_vectors: DataFrame, corpus: DataFrame,
               n: int = 10) -> DataFrame:
    """Top-``n`` documents (zero-filled) for one batch of ``(query_id, query_text)``."""
    qv = tfidf(term_counts(tokenize(batch, "query_id", "query_text"), "query_id"), idf, "query_id")
    return rank_docs(cosine_sparse(qv, doc_vectors), n, batch, corpus)


def score_query_stream(spark: SparkSession, query_dir: str, idf: DataFrame, doc_vectors: DataFrame,
                       corpus: DataFrame, out_path: str, checkpoint_path: str, n: int = 10,
                       fmt: str = "json", available_now: bool = True):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``idf``/``doc_vectors``/``corpus`` should be read from the written index
    (static side of a stream-static join); results are appended as parquet.
    """
    stream = spark.readStream.schema(QUERY_SCHEMA).format(fmt).load(query_dir)

    def write(batch: DataFrame, epoch_id: int) -> None:
        (rank_batch(batch, idf, doc_vectors, corpus, n)
         .withColumn("epoch", F.lit(epoch_id))
         .write.mode("append").parquet(out_path))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
