"""Golden numbers on the movie fixtures (word TF-IDF, precision at 1/3/5/10)."""

import os

import pytest

from conftest import FIXTURES
from lexiscope.plans.retrieval import evaluate_collection
from lexiscope.sources import read_collection, read_qrels, read_topics


def _run(spark, name):
    d = os.path.join(FIXTURES, name)
    docs = read_collection(spark, f"{d}/all.xml")
    qs = read_topics(spark, f"{d}/qry.xml")
    qrels = read_qrels(spark, f"{d}/trec.txt")
    return docs, evaluate_collection(docs, qs, qrels)


@pytest.mark.parametrize("name,expected", [
    ("movies", (1.0, 0.75, 0.68, 0.565)),
    ("movies2", (1.0, 0.616667, 0.45, 0.385)),
])
def test_mean_precision(spark, name, expected):
    _, (_, _, mean) = _run(spark, name)
    row = mean.first()
    got = tuple(round(row[f"avg_precision_at_{n}"], 6) for n in (1, 3, 5, 10))
    assert got == expected


def test_ranked_list_query_1(spark):
    docs, (ranked, _, _) = _run(spark, "movies")
    r = ranked.filter("query_id = '1'").orderBy("rank").collect()
    assert [x["docno"] for x in r] == ["1", "19", "11", "6", "15", "18", "20", "14", "8", "13"]
    assert round(r[0]["score"], 6) == 1.0
    assert round(r[1]["score"], 6) == 0.184254


def test_ranked_list_movies2(spark):
    _, (ranked, _, _) = _run(spark, "movies2")
    r = ranked.filter("query_id = '1'").orderBy("rank").collect()
    assert [x["docno"] for x in r] == ["1", "74", "19", "11", "66", "20", "6", "18", "44", "15"]
    assert round(r[1]["score"], 6) == 0.277689


def test_fixture_shapes(spark):
    docs, _ = _run(spark, "movies")
    assert docs.count() == 20
    from lexiscope.operators.tokens import term_counts, tokenize

    toks = tokenize(docs.selectExpr("doc_idx as doc_id", "text"))
    assert toks.count() == 581
    assert term_counts(toks).count() == 516
    assert toks.select("term").distinct().count() == 335
