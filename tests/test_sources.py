"""Readers: XML collections (rooted and rootless), topics, judgments, JSON, store."""

import os

from conftest import FIXTURES
from lexiscope.sources import (
    clean_text, load_shards, load_vectors, read_collection, read_json_array, read_pairs,
    read_qrels, read_rootless_collection, read_topics, save_shards, save_vectors, vector_path,
)


def test_read_collection(spark):
    docs = read_collection(spark, os.path.join(FIXTURES, "movies2", "all.xml"))
    rows = docs.orderBy("doc_idx").collect()
    assert len(rows) == 80
    assert [r["doc_idx"] for r in rows] == list(range(80))
    assert rows[0]["doc_id"] == "1" and rows[0]["text"].startswith("This classic film")
    assert all(r["text"] == r["text"].strip() for r in rows)


def test_read_topics_multiline(spark):
    t = read_topics(spark, os.path.join(FIXTURES, "figures", "qry.xml")).collect()
    assert len(t) == 24
    first = sorted(t, key=lambda r: int(r["query_id"]))[0]
    assert first["query_text"] == "Jesus Christ"


def test_read_qrels(spark):
    q = read_qrels(spark, os.path.join(FIXTURES, "movies", "trec.txt"))
    assert q.count() == 200
    assert dict(q.dtypes) == {"topic": "string", "iter": "int", "docno": "string", "relevancy": "int"}
    assert q.filter("relevancy = 1").count() == 200


def test_rootless_collection(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cran.xml")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿\n<doc>\n<docno>1</docno>\n<title>flow  </title>\n<author>a b</author>\n"
                "<bib></bib>\n<text>  boundary layer\nstudy</text>\n</doc>\n"
                "<doc>\n<docno> 2 </docno>\n<title>  </title>\n<author/>\n<bib>j. ae. 25</bib>\n"
                "<text>heat transfer</text>\n</doc>\n")
    rows = read_rootless_collection(spark, p).orderBy("doc_idx").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [
        ("1", "flow a b boundary layer\nstudy"), ("2", "j. ae. 25 heat transfer")]


def test_json_array(spark):
    df = read_json_array(spark, os.path.join(FIXTURES, "figures.json"))
    assert df.count() == 50
    assert df.select("figure").distinct().count() == 5


def test_pairs_csv_and_bom(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('id,qid1,qid2,question1,question2,is_duplicate\n'
                '0,1,2,"What is a, b?","What is b?",0\n'
                '1,3,4,"Multi\nline","x ""quoted""",1\n')
    rows = read_pairs(spark, p).orderBy("pos").collect()
    assert [(r["question1"], r["question2"], r["is_duplicate"]) for r in rows] == [
        ("What is a, b?", "What is b?", 0), ("Multi\nline", 'x "quoted"', 1)]
    df = spark.createDataFrame([("﻿  hello",)], "text string")
    assert clean_text(df).first()["text"] == "hello"


def test_store_roundtrip(spark, tmpdir_path):
    v = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "doc_id long, term string, weight double")
    path = vector_path(tmpdir_path, "bag_of_words", "movies")
    assert load_vectors(spark, path) is None
    save_vectors(v, path)
    assert sorted(load_vectors(spark, path).collect()) == sorted(v.collect())
    sp = os.path.join(tmpdir_path, "shards")
    save_shards(spark.range(10).withColumnRenamed("id", "doc_idx"), sp, 3)
    assert load_shards(spark, sp).count() == 10
    assert len([f for f in os.listdir(sp) if f.endswith(".parquet")]) >= 4


def test_read_labelled(spark, tmpdir_path):
    from lexiscope.sources import read_labelled

    p = os.path.join(tmpdir_path, "labelled")
    spark.createDataFrame([(1, "a text", 3), (2, "b text", 0)], "doc_id long, text string, label long") \
        .write.parquet(p)
    df = read_labelled(spark, p)
    assert dict(df.dtypes) == {"doc_id": "bigint", "text": "string", "label": "int"}
    assert sorted((r["doc_id"], r["label"]) for r in df.collect()) == [(1, 3), (2, 0)]
