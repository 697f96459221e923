"""Scoring in place, concept bags, blocked counts and sized parts, held against plain rules on rows made here."""

from functools import partial

import numpy as np
import pytest

from lexiscope.operators.concepts import RuleWordEncoder, concept_bags, encode_texts, formula_sae, sae_topk
from lexiscope.operators.ranking import rank_docs
from lexiscope.operators.similarity import cosine_sparse, counts_above
from lexiscope.operators.tokens import by_text, term_counts, tokenize


def _vectors(spark, seed, n, terms=30, entries=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = np.unique(np.minimum(rng.zipf(1.6, entries), terms))
        w = rng.random(len(own)) + 0.1
        w /= np.sqrt((w * w).sum())
        rows += [(i, f"t{t}", float(x)) for t, x in zip(own, w)]
    return rows


def _dots(q, d):
    out = {}
    for a, t, x in q:
        for b, u, y in d:
            if t == u:
                out[a, b] = out.get((a, b), 0.0) + x * y
    return out


@pytest.mark.parametrize("query_bytes", [64 << 20, 300])
def test_cosine_sparse_of_few_queries_is_scored_in_place(spark, query_bytes):
    q, d = _vectors(spark, 1, 5), _vectors(spark, 2, 60)
    docs = spark.createDataFrame(d, "doc_id long, term string, weight double")
    queries = spark.createDataFrame([*q, (None, "t1", 0.5)], "query_id long, term string, weight double")
    expected = _dots([*q, (None, "t1", 0.5)], d)
    got = cosine_sparse(queries, docs, query_bytes=query_bytes, score_bytes=2000)
    if query_bytes > 300:  # no pair is shuffled to be summed
        assert "hashpartitioning(_q" not in got._jdf.queryExecution().toString()
    assert {(r[0], r[1]): r[2] for r in got.collect()} == pytest.approx(expected)
    best = cosine_sparse(queries, docs, query_bytes=query_bytes, score_bytes=2000, best=4)
    ranking = lambda s: [tuple(r)[:2] + (r["rank"],) for r in rank_docs(s, 4).orderBy("query_id", "rank").collect()]
    assert ranking(best) == ranking(got)


def test_concept_bags_count_what_tokens_give(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (1, "dd"), (None, "ee ff"), (3, ""), (4, None)], "doc_id long, text string")
    make, weights, ks = partial(RuleWordEncoder, 8), partial(formula_sae, 8, 12), (5, 2)
    top = sae_topk(encode_texts(docs, "doc_id", "text", make), "hidden", weights, max(ks), ["doc_id", "pos"]).collect()
    for k in ks:
        expected, got = {}, {}
        for r in top:
            if r["rank"] <= k:
                expected[r["doc_id"], r["concept"]] = expected.get((r["doc_id"], r["concept"]), 0) + 1
        for r in concept_bags(docs, "doc_id", "text", make, weights, ks).filter(f"k = {k}").collect():
            got[r["doc_id"], r["concept"]] = got.get((r["doc_id"], r["concept"]), 0) + r["cnt"]
        assert got == expected


@pytest.mark.parametrize("block_vectors,dense_terms", [(7, 3), (1000, 512)])
def test_counts_above_meet_every_pair_once(spark, block_vectors, dense_terms):
    v = _vectors(spark, 3, 40) + [(40, "alone", 1.0)]
    vectors = spark.createDataFrame(v, "doc_idx long, term string, weight double")
    queries = spark.createDataFrame([(i,) for i in range(0, 41, 2)], "qidx long")
    thresholds, dots = (0.1, 0.5, 0.9), _dots(v, v)
    got = {(r[0], r[1]): r[2] for r in counts_above(vectors, queries, thresholds, block_vectors=block_vectors,
                                                    dense_terms=dense_terms).collect()}
    assert got == {(q, t): sum(round(s, 9) > t for (a, _), s in dots.items() if a == q) for q in range(0, 41, 2) for t in thresholds}


def test_parts_of_counted_text_follow_its_bytes(spark):
    docs = spark.createDataFrame([(i, "aa bb cc") for i in range(200)] + [(None, None)], "doc_id long, text string")
    assert by_text(docs, task_bytes=80).rdd.getNumPartitions() == 20
    assert by_text(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert term_counts(tokenize(by_text(docs, task_bytes=80))).count() == 600


def test_counts_above_leave_no_blocks_behind(spark):
    import os

    from lexiscope.session import scratch_path

    vectors = spark.createDataFrame(_vectors(spark, 5, 30), "doc_idx long, term string, weight double")
    queries = spark.range(30).toDF("qidx")
    counts_above(vectors, queries, (0.5,))  # the folder exists
    folder = scratch_path(spark, "").rstrip("/").removeprefix("file:")
    before = set(os.listdir(folder))
    got = counts_above(vectors, queries, (0.2, 0.5))
    assert len(set(os.listdir(folder)) - before) == 1  # the counts alone
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString() and got.count() == 60


def _exchanges(df):
    """Keys of the shuffles in the plan of ``df`` without broadcast joins."""
    import re

    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


@pytest.mark.parametrize("parts", [4, 9])
def test_weights_and_pair_cosines_leave_vectors_in_place(spark, parts):
    from lexiscope.operators.similarity import pair_cosine
    from lexiscope.operators.tokens import PART, parted
    from lexiscope.operators.util import bucketed
    from lexiscope.operators.weights import doc_count, fit_idf, fit_tfidf_in_place, tfidf

    texts = [(0, "aa bb cc aa"), (1, "aa dd"), (2, ""), (3, "bb bb ee"), (4, "aa bb cc aa"), (5, "zz"), (None, "aa qq"), (None, "qq")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counts = term_counts(tokenize(by_text(docs, parts=parts)))
    here = fit_tfidf_in_place(parted(counts, "doc_id", parts), doc_count(docs))
    assert [k for k in _exchanges(here) if "doc_id" in k] == []  # neither the join with idf nor the norm moves counts
    vectors = tfidf(counts, fit_idf(counts, doc_count(docs)))
    rows = lambda d: sorted((str(r.doc_id), r.term, round(r.weight, 12)) for r in d.collect())
    assert rows(here) == rows(vectors)

    pairs = spark.createDataFrame([(0, 4), (0, 1), (1, 3), (2, 0), (3, 3), (5, 0), (0, 4), (7, 1), (None, 1), (1, None)],
                                  "q1idx long, q2idx long")
    lain = bucketed(here, PART, parts)
    own = pair_cosine(pairs, lain, parts=parts)
    assert not any("_t" in k for k in _exchanges(own))  # no entry goes by its term
    sims = lambda d: sorted((str(r.q1idx), str(r.q2idx), round(r.similarity, 12)) for r in d.collect())
    assert sims(own) == sims(pair_cosine(pairs, vectors))


def test_distinct_texts_are_taken_from_where_they_lie(spark):
    from lexiscope.operators.pairs import distinct_texts, stack_texts
    from lexiscope.operators.util import bucketed

    rows = [(3, "a", "b"), (5, "b", None), (8, None, "c"), (9, "c", "a"), (9, "d", "c"), (9, "d", "e"), (11, "", "b")]
    pairs = spark.createDataFrame(rows, "pos long, question1 string, question2 string")
    lain = bucketed(pairs, "pos", 4)
    got = distinct_texts(stack_texts(lain), pairs=lain)
    texts = [r.text for r in got.orderBy("doc_idx").collect()]
    assert texts[:3] == ["a", "b", None] and set(texts[3:5]) == {"c", "d"} and texts[5:] == ["", "e"]
    assert sorted(r.doc_idx for r in got.collect()) == list(range(7))
    assert not any("text" in k for k in _exchanges(got))  # digests are grouped, not texts


def test_parts_do_not_share_buckets(spark):
    from pyspark.sql import functions as F

    from lexiscope.operators.tokens import PART, part_of, parted

    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for parts in (1, 8, 13):
        rows = ids.select(part_of("doc_id", parts).alias("p"), F.pmod(F.hash("doc_id"), F.lit(parts)).alias("m"))
        assert rows.distinct().count() == rows.select("p").distinct().count() == parts
        lain = parted(ids, "doc_id", parts).groupBy(F.pmod(F.hash(PART), F.lit(parts)).alias("bucket")).count()
        assert lain.count() == parts


def test_factor_step_moves_sums_and_no_entries(spark):
    from pyspark.sql import functions as F

    from lexiscope.operators.cluster import hash_start, nmf_update, term_start
    from lexiscope.operators.tokens import PART, parted

    rows = [(d, f"t{(d * 5 + j * j) % 23}", 0.1 + (d + j) % 4) for d in range(60) for j in range(6)]
    x = spark.createDataFrame(sorted({(d, t): w for d, t, w in rows}.items()), "key struct<doc_id long, term string>, weight double")
    x = x.select("key.*", "weight")
    start = lambda x: (x.select(*[c for c in (PART,) if c in x.columns], "doc_id").distinct()
                       .withColumn("v", hash_start(F.col("doc_id"), 3)),
                       x.select("term").distinct().withColumn("v", term_start(F.col("term"), 3)))
    lain = parted(x, "doc_id", 5)
    (w, h), (w_lain, h_lain) = nmf_update(x, *start(x), 3), nmf_update(lain, *start(lain), 3, parts=5)
    for one, two in ((w, w_lain), (h, h_lain)):
        assert one.columns == two.columns
        same = lambda d: sorted((r[0], *np.round(r[1], 9)) for r in d.collect())
        assert same(one) == same(two)
    assert [k for k in _exchanges(w_lain) if "doc_id" in k] == []
