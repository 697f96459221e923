"""Steps that move or hold no more than they need, held against plain rules on rows made here."""

import pytest

from lexiscope.operators.similarity import counts_above
from lexiscope.operators.tokens import parted
from test_findings_r03 import _dots, _vectors


def _recorded(monkeypatch):
    """Plans of all tables written through ``checkpointed``."""
    from lexiscope.operators import util

    plans, write = [], util.checkpointed

    def checkpointed(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **options)

    monkeypatch.setattr(util, "checkpointed", checkpointed)
    return plans


@pytest.mark.parametrize("parts,block_vectors,block_entries", [(None, 20, 10 ** 6), (5, 1000, 100)])
def test_counts_above_send_blocks_and_move_no_vector_per_block(spark, monkeypatch, parts, block_vectors, block_entries):
    v = _vectors(spark, 4, 50) + [(50, "alone", 1.0)]
    vectors = spark.createDataFrame(v, "doc_idx long, term string, weight double")
    queries = spark.createDataFrame([(i,) for i in range(0, 51, 3)] + [(1000,)], "qidx long")
    thresholds, dots = (0.1, 0.5, 0.9), _dots(v, v)
    own = parted(vectors, "doc_idx", parts) if parts else vectors
    plans = _recorded(monkeypatch)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = counts_above(own, queries, thresholds, dense_terms=4, block_vectors=block_vectors, parts=parts,
                              block_entries=block_entries)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    got = {(r[0], r[1]): r[2] for r in counts.collect()}
    assert got == {(q, t): sum(round(s, 9) > t for (a, _), s in dots.items() if a == q) for q in range(0, 51, 3) for t in thresholds}
    assert plans and not any("explode" in p or "FlatMapGroups" in p for p in plans)
    packing = next(p for p in plans if "collect_list" in p)
    if parts:  # entries stay in their part: only terms, their numbers and the queries move
        assert packing.count("Exchange hashpartitioning(_part") == 2
        assert packing.count("Exchange hashpartitioning(_d") == 1  # the distinct queries


def test_word_methods_move_no_counts_and_judgments_no_texts(spark):
    from pyspark.sql import functions as F

    from lexiscope.operators.weights import doc_count, fit_idf, tfidf
    from lexiscope.plans import retrieval as R
    from lexiscope.operators.judgments import contains_judgments
    from test_findings_r03 import _exchanges

    texts = [(1, "aa bb the cc aa"), (2, "aa dd the"), (3, ""), (4, "bb the bb ee"), (5, "zz the"), (5, "zz ff"), (None, "aa qq"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(7, "aa bb"), (8, "the zz nowhere"), (9, "nothing")], "query_id long, query_text string")
    ix = R.word_index(docs, queries)
    rows = lambda d: sorted((str(r[0]), str(r[1]), round(r[2], 12)) for r in d.collect())
    assert not any("doc_id" in k for k in _exchanges(ix.doc_vectors))  # neither join nor norm moves counts
    for one in (ix, R.without_stopwords(ix, ["the"])):
        counts = one._counts()
        plain = tfidf(counts, fit_idf(counts, doc_count(docs)))
        assert rows(one.doc_vectors) == rows(plain)
        qv = one.query_vectors.select("query_id", "term", F.col("weight").alias("qw"))
        dots = qv.join(plain, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
        found = R.scores(one)
        assert "hashpartitioning(_d" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == rows(dots)
    passages = spark.createDataFrame([(20, "bb the cc"), (21, "a the b"), (22, "aa"), (23, ", zz ")], "item_id long, text string")
    found = contains_judgments(docs, passages, ix.doc_counts, ix.idf)
    assert "hashpartitioning(_did" not in found._jdf.queryExecution().executedPlan().toString()  # few candidates go to the texts
    held = {(p, d) for p, x in [(20, "bb the cc"), (21, "a the b"), (22, "aa"), (23, ", zz ")] for d, t in texts
            if t is not None and d is not None and x in t}
    assert {(r.topic, r.docno) for r in found.collect() if r.docno is not None} == held


def test_a_task_of_the_factorisation_holds_one_block(spark):
    from pyspark.sql import functions as F

    from lexiscope.operators.factorize import BlockedMatrices, block_names

    rows = [(m, f"r{r}", c, 1.0 + (r * 7 + c) % 5) for m, n in (("a", 150), ("b", 40)) for r in range(n) for c in range(r % 3, 30, 5)]
    blocked = BlockedMatrices(spark.createDataFrame(rows, "method string, row string, col int, value double"), block_values=100)
    assert blocked.n_blocks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = blocked.blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in met}) == len(met) == blocked.n_blocks
    assert {r.block >> 32 for r in met} == {0, 1}
    entries = sum(len(b["value"]) // 8 for b in blocked.blocks.collect())
    assert entries == len(rows)
    names = block_names(spark, [3, 1, 5])
    assert [len(x) for x in names] == [3, 1, 5] and all(x >> 32 == m for m, own in enumerate(names) for x in own)


def test_texts_do_not_move_to_a_short_list_of_pairs(spark):
    from lexiscope.plans import pair_eval as P

    pairs = spark.createDataFrame([(0, "aa bb", "cc"), (1, "cc", "dd ee"), (2, "dd ee", "aa bb"), (3, "aa bb", "ff")],
                                  "pos long, question1 string, question2 string")
    ps = P.pair_set(pairs)
    number = {r.text: r.doc_idx for r in ps.texts.collect()}
    listed = spark.createDataFrame([(number["aa bb"], number["ff"], 0.5), (number["cc"], number["cc"], 1.0)],
                                   "q1idx long, q2idx long, similarity double")
    found = P.with_pair_texts(listed, ps)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_idx" not in plan and "hashpartitioning(q" not in plan
    assert sorted((r.q1, r.q2, r.similarity) for r in found.collect()) == [("aa bb", "ff", 0.5), ("cc", "cc", 1.0)]
