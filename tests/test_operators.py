"""Operator behaviour on hand-made rows (edge cases of the semantics)."""

import math

import pytest
from pyspark.sql import functions as F

from lexiscope.operators.cluster import adjusted_rand, cluster_labels
from lexiscope.operators.groups import next_in_group, with_positions
from lexiscope.operators.pairs import (
    distinct_texts, pair_extremes, pair_positions, partner_last_wins, partner_symmetric,
    stack_texts, threshold_counts, threshold_curve, threshold_hits, threshold_scores,
)
from lexiscope.operators.ranking import precision_at, rank_docs, ranked_hits, relevant
from lexiscope.operators.sampling import sample_exact
from lexiscope.operators.similarity import cosine_sparse
from lexiscope.operators.tokens import remove_stopwords, term_counts, tokenize
from lexiscope.operators.weights import concept_strings, doc_count, fit_idf, tfidf


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _vec(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_tokenizer_unicode_and_short_tokens(spark):
    d = _docs(spark, ["a bb 7 77", "Été à Köln", ""])
    toks = [(r["doc_id"], r["term"]) for r in tokenize(d).orderBy("doc_id", "pos").collect()]
    assert toks == [(0, "bb"), (0, "77"), (1, "été"), (1, "köln")]


def test_learned_vs_fixed_vocabulary(spark):
    d = _docs(spark, ["aa bb", "bb cc"])
    q = spark.createDataFrame([(0, "bb zz")], "query_id long, query_text string")
    counts = term_counts(tokenize(d))
    n = doc_count(d)
    idf = fit_idf(counts, n)
    qc = term_counts(tokenize(q, "query_id", "query_text"), "query_id")
    learned = _vec(tfidf(qc, idf, "query_id"))
    assert learned == {(0, "bb"): pytest.approx(1.0)}
    fixed = _vec(tfidf(qc, idf, "query_id", vocabulary="fixed", n_docs=n))
    # bb: idf ln(3/3)+1 = 1; zz: unseen, idf ln(3)+1
    zz = math.log(3) + 1
    norm = math.sqrt(1 + zz * zz)
    assert fixed[(0, "bb")] == pytest.approx(1 / norm)
    assert fixed[(0, "zz")] == pytest.approx(zz / norm)
    dv = tfidf(counts, idf)
    s_l = cosine_sparse(tfidf(qc, idf, "query_id"), dv).collect()
    s_f = cosine_sparse(tfidf(qc, idf, "query_id", vocabulary="fixed", n_docs=n), dv).collect()
    rank_l = sorted(s_l, key=lambda r: (-round(r["score"], 9), -r["doc_id"]))
    rank_f = sorted(s_f, key=lambda r: (-round(r["score"], 9), -r["doc_id"]))
    assert [r["doc_id"] for r in rank_l] == [r["doc_id"] for r in rank_f]
    assert all(a["score"] > b["score"] for a, b in zip(rank_l, rank_f))


def test_empty_text_counts_in_n(spark):
    d = _docs(spark, ["aa", ""])
    counts = term_counts(tokenize(d))
    idf = fit_idf(counts, doc_count(d)).collect()
    assert idf[0]["df"] == 1 and idf[0]["idf"] == pytest.approx(math.log(3 / 2) + 1)
    assert tfidf(counts, fit_idf(counts, doc_count(d))).filter("doc_id = 1").count() == 0


def test_weights_unit_norm_and_self_similarity(spark):
    d = _docs(spark, ["the cat sat on the mat", "the dog", "cat cat dog"])
    counts = term_counts(tokenize(d))
    v = tfidf(counts, fit_idf(counts, doc_count(d)))
    norms = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    s = cosine_sparse(v.withColumnRenamed("doc_id", "query_id"), v).collect()
    assert all(0 <= r["score"] <= 1 + 1e-12 for r in s)
    assert all(r["score"] == pytest.approx(1.0) for r in s if r["query_id"] == r["doc_id"])


def test_stopwords(spark):
    toks = tokenize(_docs(spark, ["The cat and the hat"]))
    assert [r["term"] for r in remove_stopwords(toks, ["the", "and"]).collect()] == ["cat", "hat"]
    sw = spark.createDataFrame([("cat",)], "w string")
    assert [r["term"] for r in remove_stopwords(toks, sw).orderBy("pos").collect()] == ["the", "and", "the", "hat"]


def test_concept_ids_as_text_vs_counts(spark):
    c = spark.createDataFrame([(0, [3, 12])], "doc_id long, concepts array<int>")
    s = concept_strings(c)
    assert [r["term"] for r in tokenize(s).collect()] == ["12"]


def test_equal_scores_and_zero_fill(spark):
    scores = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "query_id long, doc_id long, score double")
    corpus = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    r = rank_docs(scores, 3, queries, corpus).orderBy("query_id", "rank").collect()
    assert [(x["query_id"], x["doc_id"], x["rank"]) for x in r] == [
        (0, 2, 1), (0, 1, 2), (0, 4, 3), (1, 4, 1), (1, 3, 2), (1, 2, 3)]
    qrels = spark.createDataFrame([(0, 1, 1), (0, 3, 2), (7, 4, 1)], "topic long, docno long, relevancy int")
    hits = ranked_hits(rank_docs(scores, 3, queries, corpus), relevant(qrels))
    p = {x["query_id"]: x for x in precision_at(hits, queries, (1, 3)).collect()}
    assert p[0]["precision_at_1"] == 0.0 and p[0]["precision_at_3"] == pytest.approx(1 / 3)
    assert p[1]["precision_at_1"] == 0.0 and p[1]["precision_at_3"] == 0.0


def test_partner_maps(spark):
    pairs = spark.createDataFrame([(0, "A", "B"), (1, "A", "C"), (2, "B", "C")],
                                  "pos long, question1 string, question2 string")
    texts = distinct_texts(stack_texts(pairs))
    idx = {r["text"]: r["doc_idx"] for r in texts.collect()}
    assert idx == {"A": 0, "B": 1, "C": 2}
    pp = pair_positions(pairs, texts)
    lw = {r["q1idx"]: r["q2idx"] for r in partner_last_wins(pp).collect()}
    assert lw == {0: 2, 1: 2}
    sym = {r["qidx"]: r["partner"] for r in partner_symmetric(pp).collect()}
    # A->C (last), B->A (reversed pair overrides B->C), C->B (last reversed)
    assert sym == {0: 2, 1: 0, 2: 1}


def test_threshold_zero_count(spark):
    sc = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.25), (1, 1, 1.0)], "qidx long, doc_idx long, score double")
    partners = spark.createDataFrame([(0, 1), (1, 5)], "qidx long, partner long")
    counts = threshold_counts(sc, (0.2, 0.5))
    hits = threshold_hits(sc, partners, (0.2, 0.5))
    per = {(r["qidx"], r["threshold"]): r["score"] for r in threshold_scores(counts, hits).collect()}
    assert per == {(0, 0.2): 0.5, (0, 0.5): 0.0, (1, 0.2): 0.0, (1, 0.5): 0.0}
    curve = {r["threshold"]: r["score"] for r in threshold_curve(threshold_scores(counts, hits)).collect()}
    assert curve == {0.2: 0.25, 0.5: 0.0}


def test_pair_extremes_short_list(spark):
    s = spark.createDataFrame([(0, 1, 0.3, 0), (1, 0, 0.1, 1), (2, 0, 0.3, 2)],
                              "q1idx long, q2idx long, similarity double, first_pos long")
    e = pair_extremes(s, 2).orderBy("kind", "rank").collect()
    assert [(x["kind"], x["q1idx"]) for x in e] == [("highest", 0), ("highest", 2), ("lowest", 1), ("lowest", 0)]


def test_ari(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 7), (1, 7), (2, 9)], "label long, cluster long")
    assert adjusted_rand(df, "label", "cluster").first()["ari"] == pytest.approx(1.0)
    one = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (2, 0)], "label long, cluster long")
    assert adjusted_rand(one, "label", "cluster").first()["ari"] == pytest.approx(0.0)
    both = spark.createDataFrame([(0, 0), (0, 0)], "label long, cluster long")
    assert adjusted_rand(both, "label", "cluster").first()["ari"] == 1.0
    sw = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (2, 2)], "label long, cluster long")
    a = adjusted_rand(sw, "label", "cluster").first()["ari"]
    b = adjusted_rand(sw.selectExpr("cluster as label", "label as cluster"), "label", "cluster").first()["ari"]
    assert a == pytest.approx(b)


def test_zero_row_cluster(spark):
    w = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [0.1, 0.5, 0.5])], "doc_id long, v array<double>")
    assert {r["doc_id"]: r["cluster"] for r in cluster_labels(w).collect()} == {0: 0, 1: 1}


def test_next_in_group_and_positions(spark):
    rows = [(i, "s%d" % (i % 3), f"t{i}") for i in range(0, 300, 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["next_text"] for r in next_in_group(df, ["source"], "doc_id", ["text"]).collect()}
    for s in ("s0", "s1", "s2"):
        ids = sorted(i for i, src, _ in rows if src == s)
        for a, b in zip(ids, ids[1:] + [None]):
            assert got[a] == (None if b is None else f"t{b}")
    pos = {r["doc_id"]: r["doc_idx"] for r in with_positions(df, "doc_id").collect()}
    assert [pos[i] for i, _, _ in rows] == list(range(len(rows)))


def test_sample_exact_count(spark):
    df = spark.range(1234).withColumnRenamed("id", "doc_id")
    s = sample_exact(df, "doc_id", 0.01, 42)
    assert s.count() == 12
    assert sorted(r[0] for r in s.collect()) == sorted(r[0] for r in sample_exact(df, "doc_id", 0.01, 42).collect())


def test_cosine_above_is_exact(spark):
    import random

    from lexiscope.operators.similarity import cosine_above

    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(words[: rnd.randint(3, 30)]) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    d = _docs(spark, texts)
    counts = term_counts(tokenize(d))
    v = tfidf(counts, fit_idf(counts, doc_count(d)))
    q = v.withColumnRenamed("doc_id", "query_id")
    full = {(r[0], r[1]): r[2] for r in cosine_sparse(q, v).collect()}
    for t in (0.1, 0.3, 0.6):
        got = {(r[0], r[1]): r[2] for r in cosine_above(q, v, t).collect()}
        assert {k for k, s in full.items() if s > t} <= set(got)
        assert all(got[k] == pytest.approx(full[k]) for k in got)


def test_contains_judgments_exact(spark):
    from lexiscope.operators.judgments import contains_judgments

    docs = _docs(spark, ["intro. The quick brown fox jumps. end", "xHello world!", "quick brown",
                         "the QUICK brown fox jumps"])
    passages = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "Hello world"), (3, "brown")],
                                     "item_id long, text string")
    counts = term_counts(tokenize(docs))
    idf = fit_idf(counts, doc_count(docs))
    got = sorted((r["topic"], r["docno"]) for r in contains_judgments(docs, passages, counts, idf).collect())
    want = sorted((pid, did) for pid, pt in [(1, "The quick brown fox jumps"), (2, "Hello world"), (3, "brown")]
                  for did, dt in enumerate(["intro. The quick brown fox jumps. end", "xHello world!",
                                            "quick brown", "the QUICK brown fox jumps"]) if pt in dt)
    assert got == want


def test_nmf_objective_falls_and_is_deterministic(spark):
    import numpy as np

    from lexiscope.operators.cluster import nmf

    d = _docs(spark, ["red apple fruit", "green apple fruit", "fast red car", "fast blue car",
                      "blue sky sea", "green sea fish", "apple pie", "car race fast"])
    counts = term_counts(tokenize(d))
    x = tfidf(counts, fit_idf(counts, doc_count(d)))
    xs = {(r["doc_id"], r["term"]): r["weight"] for r in x.collect()}
    docs = sorted({k[0] for k in xs})
    terms = sorted({k[1] for k in xs})
    X = np.zeros((len(docs), len(terms)))
    for (i, t), v in xs.items():
        X[docs.index(i), terms.index(t)] = v

    def objective(tol):
        w, h = nmf(x, 3, tol)
        W = np.array([r["v"] for r in w.orderBy("doc_id").collect()])
        H = np.array([r["v"] for r in h.orderBy("term").collect()])
        return float(((X - W @ H.T) ** 2).sum()), W

    loose, tight = objective(0.5), objective(0.01)
    assert tight[0] <= loose[0] + 1e-9 < (X ** 2).sum()
    assert np.allclose(objective(0.01)[1], tight[1])
