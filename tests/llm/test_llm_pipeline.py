"""The pipeline's stages on awkward rows, and its run against the single operators."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiscope.llm import decontaminate, packing, quality, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_tables
def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = [r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()]
    one = quality.quality_stage(spark, docs, SF).persist()
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == sorted(kept)
    classes = simhash.simhash_near_duplicates(one)
    two = simhash.simhash_stage(spark, one, SF).persist()
    assert two.columns == names
    assert sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in classes.select("component_id").distinct().collect())
    three = suffix_dedup.suffix_stage(spark, two, SF).persist()
    assert three.columns == names and three.schema == docs.schema
    want = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in
            suffix_dedup.remove_repeats(two).select("rest.doc_id", "kept").collect() if r.kept}
    assert {r.doc_id: r.text for r in three.collect()} == want
    assert three.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    four = decontaminate.decontamination_stage(spark, three, SF).persist()
    assert four.columns == names
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.benchmark_hits(three, items).filter("n_hit > 0").collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (three, four))
    assert all(after[i] == t for i, t in before.items() if i not in hit)
    assert all(after.get(i) != before[i] for i in hit)
    five = packing.packing_stage(spark, four, SF)
    assert five.select("doc_id").distinct().count() == four.count()


@needs_tables
def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert corpus_pipeline.run(spark, SF).filter("length < 1 or offset + length > 2048").count() == 0


def test_stages_take_nulls_clashing_columns_and_empty_tables(spark):
    long = " ".join(f"word{k % 700} and the other" for k in range(4000))
    rows = [(1, None, "en", "s", None, 1), (2, "", None, None, 0, 1), (3, long, "en", "s", 5, 1), (3, long, "en", "s", 5, 1),
            (None, "some words " * 30, None, "s", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF) if os.path.isdir(SF) or name != "benchmark_decontamination" else given
            assert out.count() >= 0
            if name != "best_fit_packing":
                assert out.columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("alpha beta gamma delta " * 20, "one two three four five " * 20, "red green blue white black " * 20)
    rows = [(3, a, "x"), (3, a, "x"), (1, a, "y"), (1, b, "x"), (1, b, "x"), (None, c, "x"), (None, c, "y"), (None, b, "x"),
            (None, a, "z"), (7, None, "x"), (None, "", "y"), (7, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, simhash_row string").repartition(3)
    got = [tuple(r) for r in simhash.simhash_stage(spark, docs, SF).collect()]
    assert len(got) == 4 and set(got) <= set(rows)
    assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in got) == [
        (False, 1, a), (False, 1, b), (False, 7, ""), (True, 0, c)]
