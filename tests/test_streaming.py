"""Streaming scoring equals batch scoring of the same queries."""

import json
import os

from lexiscope.operators.ranking import rank_docs
from lexiscope.operators.similarity import cosine_sparse
from lexiscope.operators.tokens import term_counts, tokenize
from lexiscope.operators.weights import doc_count, fit_idf, tfidf
from lexiscope.streaming import score_query_stream


def test_stream_matches_batch(spark, tmpdir_path):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "a dog ran"), (2, "the cat and the dog")],
                                 "doc_id long, text string")
    counts = term_counts(tokenize(docs))
    idf = fit_idf(counts, doc_count(docs))
    dv = tfidf(counts, idf)
    qdir = os.path.join(tmpdir_path, "queries")
    os.makedirs(qdir)
    qs = [(10, "cat"), (11, "dog ran"), (12, "unknown words")]
    for i, (qid, text) in enumerate(qs):
        with open(os.path.join(qdir, f"q{i}.json"), "w") as f:
            f.write(json.dumps({"query_id": qid, "query_text": text}) + "\n")
    out = os.path.join(tmpdir_path, "out")
    q = score_query_stream(spark, qdir, idf, dv, docs, out, os.path.join(tmpdir_path, "ck"), n=2)
    q.awaitTermination(120)
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in spark.read.parquet(out).collect())
    qdf = spark.createDataFrame(qs, "query_id long, query_text string")
    qv = tfidf(term_counts(tokenize(qdf, "query_id", "query_text"), "query_id"), idf, "query_id")
    want = sorted((r["query_id"], r["doc_id"], r["rank"])
                  for r in rank_docs(cosine_sparse(qv, dv), 2, qdf, docs).collect())
    assert got == want
    assert len(got) == 6
