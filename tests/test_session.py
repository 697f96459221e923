"""Scopes of intermediate tables."""

import os

from lexiscope.operators.util import checkpointed
from lexiscope.session import begin_scope, end_scope


def folder(df):
    return os.path.dirname(df.inputFiles()[0].replace("file://", ""))


def test_a_scope_deletes_what_earlier_ones_wrote_and_nobody_reads(spark):
    given = spark.range(5)
    outside = checkpointed(given)
    begin_scope(spark, "first", given)
    scratch = checkpointed(given)
    end_scope(spark)
    saved = checkpointed(scratch.withColumn("x", scratch.id + 1))
    begin_scope(spark, "second", saved)
    held = checkpointed(saved)
    end_scope(spark)
    assert not os.path.exists(folder(scratch)) and saved.count() == outside.count() == 5
    begin_scope(spark, "third", held)  # an unsaved result of the second scope is still read
    end_scope(spark)
    assert held.count() == 5
    begin_scope(spark, "fourth", given)
    end_scope(spark)
    assert not os.path.exists(folder(held)) and os.path.exists(folder(saved))
