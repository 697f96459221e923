"""Cases that once lost data or ranked wrongly."""

import os

import pytest

from pyspark.sql import functions as F

from lexiscope.operators.cluster import cluster_labels, nmf
from lexiscope.operators.ranking import rank_docs
from lexiscope.operators.tokens import remove_stopwords
from lexiscope.sources import read_rootless_collection


def test_rootless_reader_keeps_all_children_in_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "docs.xml")
    with open(path, "w", encoding="utf-8") as f:
        f.write('﻿\n<doc lang="en"><docno> 1 </docno><abstract>lost words</abstract><title>t &amp; u</title></doc>\n'
                "<doc><docno>2</docno><text>one</text><title>late</title><text> two\n</text><empty/><b>  </b></doc>"
                "<doc><docno>3</docno></doc>\n")
    rows = read_rootless_collection(spark, path).orderBy("doc_idx").collect()
    assert [(r.doc_id, r.text) for r in rows] == [("1", "lost words t & u"), ("2", "one late two"), ("3", "")]
    some = read_rootless_collection(spark, path, text_tags=["title"]).orderBy("doc_idx").collect()
    assert [r.text for r in some] == ["t & u", "late", ""]


def test_signed_scores_keep_their_order(spark):
    scores = spark.createDataFrame([("q", 0, 1.0), ("q", 1, -0.995), ("q", 2, -0.447), ("q", 3, -1.0)],
                                   "query_id string, doc_id long, score double")
    ranked = rank_docs(scores, 4).orderBy("rank").collect()
    assert [r.doc_id for r in ranked] == [0, 2, 1, 3]


def test_empty_documents_get_cluster_zero(spark):
    x = spark.createDataFrame([(0, "a", 1.0), (2, "b", 1.0), (2, "a", 0.5)], "doc_id long, term string, weight double")
    w, _ = nmf(x, 2, tol=0.1, rows=spark.range(4).withColumnRenamed("id", "doc_id"))
    labels = {r.doc_id: r.cluster for r in cluster_labels(w).collect()}
    assert set(labels) == {0, 1, 2, 3} and labels[1] == labels[3] == 0


def test_stop_words_of_a_table_are_lower_cased(spark):
    tokens = spark.createDataFrame([(1, "the"), (1, "cat")], "doc_id long, term string")
    listed = spark.createDataFrame([("The",)], "w string")
    assert [r.term for r in remove_stopwords(tokens, listed).collect()] == ["cat"]
    assert remove_stopwords(tokens, ["The"]).select(F.max("term")).first()[0] == "cat"


def test_encoders_keep_string_ids_and_rank_by_them(spark):
    from functools import partial

    from lexiscope.operators.concepts import RuleWordEncoder, embed_texts, encode_texts
    from lexiscope.operators.similarity import cosine_dense_topn

    make = partial(RuleWordEncoder, 8)
    docs = spark.createDataFrame([("MED-1", "a b"), ("9", "a b"), ("80", None)], "doc_id string, text string")
    assert {(r.doc_id, r.pos) for r in encode_texts(docs, "doc_id", "text", make).collect()} == {
        ("MED-1", 0), ("MED-1", 1), ("9", 0), ("9", 1)}
    emb = embed_texts(docs, "doc_id", "text", make)
    top = cosine_dense_topn(emb.withColumnRenamed("doc_id", "query_id"), emb, 3).filter("query_id = '9'")
    assert [r.doc_id for r in top.orderBy("rank").collect()] == ["MED-1", "9", "80"]


def test_concepts_in_blocks_of_columns(spark):
    from functools import partial

    import numpy as np

    from lexiscope.operators.concepts import formula_sae, sae_topk

    make = partial(formula_sae, 4, 65_536)
    x = spark.createDataFrame([(i, [float(i), 1.0, -2.0, 0.5 * i]) for i in range(5)], "id long, v array<double>")
    got = {(r.id, r["rank"]): (r.concept, round(r.act, 9)) for r in sae_topk(x, "v", make, 5, ["id"]).collect()}
    w, b = make()
    for i in range(5):
        acts = np.maximum(np.array([float(i), 1.0, -2.0, 0.5 * i]) @ w + b, 0.0)
        best = np.argsort(-np.round(acts, 6), kind="stable")[:5]
        assert [got[(i, r + 1)] for r in range(5)] == [(int(c), round(acts[c], 9)) for c in best]


def test_bare_passages_need_no_cross_join(spark):
    from lexiscope.operators.judgments import contains_judgments
    from lexiscope.operators.tokens import term_counts, tokenize
    from lexiscope.operators.weights import doc_count, fit_idf

    texts = ["alpha beta", "xalpha bety", "gamma", None, "alp"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = ["alp", "alpha bet", "", "gamma", "gamma", "zeta", None]
    passages = spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string")
    counts = term_counts(tokenize(docs))
    found = contains_judgments(docs, passages, counts, fit_idf(counts, doc_count(docs)), block_bytes=8)
    assert sorted((r.topic, r.docno) for r in found.collect()) == sorted(
        (p, d) for p, x in enumerate(wanted) for d, t in enumerate(texts) if x is not None and t is not None and x in t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_outlying_key_does_not_fill_one_range(spark):
    from lexiscope.operators.groups import with_positions

    df = spark.range(20_000).union(spark.createDataFrame([(10**15,)], "id long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together
    try:
        dealt = df.repartitionByRange("id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt < 15_000
    pos = with_positions(df, "id", "pos")
    assert pos.filter("pos <> least(id, 20000)").count() == 0 and pos.count() == 20_001


def test_stored_counts_are_read_back_only_for_their_corpus_and_settings(spark, tmpdir_path):
    from lexiscope.plans.retrieval import word_index

    docs = spark.createDataFrame([(0, "red the car"), (1, "blue the car")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red")], "query_id long, query_text string")

    def terms(given, **options):
        ix = word_index(given, queries, store=tmpdir_path, **options)
        return sorted((r.doc_id, r.term, r.cnt if "cnt" in r else r[2]) for r in ix.doc_counts.collect())

    without = terms(docs, stopwords=["the"])
    folders = set(os.listdir(f"{tmpdir_path}/counts/data"))
    assert {t for _, t, _ in without} == {"red", "blue", "car"}
    assert terms(docs.repartition(3), stopwords=["The", "the"]) == without  # the same rows and words: read back
    assert set(os.listdir(f"{tmpdir_path}/counts/data")) == folders
    assert {t for _, t, _ in terms(docs)} == {"red", "blue", "car", "the"}
    other = spark.createDataFrame([(0, "green tree"), (1, None)], "doc_id long, text string")
    assert {t for _, t, _ in terms(other)} == {"green", "tree"}
    listed = spark.createDataFrame([("car",)], "w string")
    assert {t for _, t, _ in terms(docs, stopwords=listed)} == {"red", "blue", "the"}


def test_an_interrupted_publication_is_made_anew(spark, tmpdir_path):
    from lexiscope.sources.store import corpus_digest, load_vectors, publish, published

    rows = spark.range(5)
    os.makedirs(f"{tmpdir_path}/manifest/k")  # a manifest that was begun, rows without one
    os.makedirs(f"{tmpdir_path}/data/left")
    os.makedirs(f"{tmpdir_path}/half/_temporary")
    assert published(spark, tmpdir_path, "k") is None and load_vectors(spark, f"{tmpdir_path}/half") is None
    publish(rows, tmpdir_path, "k")
    publish(rows.limit(0), tmpdir_path, "none")
    assert published(spark, tmpdir_path, "k").count() == 5 and published(spark, tmpdir_path, "none").count() == 0
    assert published(spark, tmpdir_path, "other") is None
    a = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    b = spark.createDataFrame([(2, ""), (1, "a")], "x int, y string")
    assert corpus_digest(a) == corpus_digest(a.repartition(3)) != corpus_digest(b)
    assert corpus_digest(a.union(a)) != corpus_digest(a)


def test_stopped_shard_writes_go_on_and_give_each_row_once(spark, tmpdir_path):
    from lexiscope.sources.store import load_published_shards, write_shards_resumable

    rows, made = spark.range(50).withColumnRenamed("id", "doc_id"), []

    def make(part):
        made.append(part)
        if len(made) == 4:
            raise KeyboardInterrupt
        return part.withColumn("act", part.doc_id * 2)

    with pytest.raises(KeyboardInterrupt):
        write_shards_resumable(rows, tmpdir_path, "doc_id", make, parts=6, rows_per_file=3)
    assert 0 < load_published_shards(spark, tmpdir_path).count() < 50
    assert write_shards_resumable(rows.repartition(4), tmpdir_path, "doc_id", make, parts=6) == 3
    got = load_published_shards(spark, tmpdir_path).collect()
    assert sorted((r.doc_id, r.act) for r in got) == [(i, 2 * i) for i in range(50)]
    assert write_shards_resumable(rows, tmpdir_path, "doc_id", make, parts=6) == 0
    with pytest.raises(ValueError, match="other rows"):
        write_shards_resumable(spark.range(3).withColumnRenamed("id", "doc_id"), tmpdir_path, "doc_id", make, parts=6)


def test_reports_have_the_shape_of_a_map(spark, tmpdir_path):
    import json

    from lexiscope.operators.report import write_comparison, write_extremes

    cmp = spark.createDataFrame([("p1", 0.5, None), ("p3", 0.25, 1.0)], "metric string, words double, dense double")
    write_comparison(cmp, tmpdir_path + "/cmp")
    assert json.loads(spark.read.text(tmpdir_path + "/cmp").first()[0]) == {
        "p1": {"words": 0.5}, "p3": {"words": 0.25, "dense": 1.0}}
    ext = spark.createDataFrame([("k1", "highest", 2, "c", "d", 0.9), ("k1", "highest", 1, "a", "b", 0.8),
                                 ("k1", "lowest", 1, "e", "f", 0.0)],
                                "method string, kind string, rank long, q1 string, q2 string, similarity double")
    write_extremes(ext, tmpdir_path + "/ext")
    assert json.loads(spark.read.text(tmpdir_path + "/ext").first()[0]) == {"k1": {
        "highest": [{"q1": "a", "q2": "b", "similarity": 0.8}, {"q1": "c", "q2": "d", "similarity": 0.9}],
        "lowest": [{"q1": "e", "q2": "f", "similarity": 0.0}]}}
