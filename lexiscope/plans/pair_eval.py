"""Paired-text evaluation: pair similarity extremes and the threshold curve."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.concepts import concept_bags
from lexiscope.operators.pairs import (
    THRESHOLDS, distinct_texts, numbered_digests, pair_positions, partner_last_wins, partner_symmetric,
    stack_texts, threshold_counts, threshold_curve, threshold_hits, threshold_scores,
)
from lexiscope.operators.similarity import cosine_above, cosine_sparse, counts_above, pair_cosine
from lexiscope.operators.tokens import PART, by_text, parted, term_counts, text_parts, tokenize
from lexiscope.operators.util import bucketed, checkpointed
from lexiscope.operators.weights import doc_count, fit_idf, fit_tfidf_in_place, tfidf
from lexiscope.plans import tables
from lexiscope.plans.concept_eval import concept_counts

#: postings of one term that meet in one place of the self-join
SPLIT_ROWS = 20_000


class PairSet:
    """Pairs with their distinct texts, positions, partner maps and TF-IDF vectors, built as they are used.

    Tables that several others read are written once to the shared folder
    (``materialize``); the rest are lazy plans.
    """

    def __init__(self, pairs: DataFrame, materialize: bool = True):
        self.pairs = pairs
        self.in_place = materialize  # vectors lie in parts
        self._kept = checkpointed if materialize else (lambda df: df)

    @cached_property
    def stacked(self) -> DataFrame:
        return stack_texts(self.pairs)

    @cached_property
    def stored_pairs(self) -> DataFrame:
        if not self.in_place:
            return self.pairs
        return bucketed(self.pairs, "pos", int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @cached_property
    def texts(self) -> DataFrame:
        if not self.in_place:
            return distinct_texts(stack_texts(self.pairs))
        return distinct_texts(stack_texts(self.stored_pairs), pairs=self.stored_pairs, numbered=self.numbered)

    @cached_property
    def numbered(self) -> DataFrame:
        return numbered_digests(stack_texts(self.stored_pairs))

    @cached_property
    def positions(self) -> DataFrame:
        return self._kept(pair_positions(self.stored_pairs, self.numbered if self.in_place else self.texts))

    @cached_property
    def last_wins(self) -> DataFrame:
        return partner_last_wins(self.positions)

    @cached_property
    def symmetric(self) -> DataFrame:
        return partner_symmetric(self.positions)

    @cached_property
    def vectors(self) -> DataFrame:
        if self.in_place:
            return self.parted_vectors.select("doc_idx", "term", "weight")
        counts = term_counts(tokenize(by_text(self.texts, "doc_idx"), "doc_idx"), "doc_idx")
        return tfidf(counts, fit_idf(counts, doc_count(self.texts)), "doc_idx")

    @cached_property
    def parts(self) -> int:
        # Spark moves a bucketed side of a join that has fewer parts than its shuffles
        return max(text_parts(self.texts), int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @cached_property
    def parted_vectors(self) -> DataFrame:
        """The vectors with their part, in the place where their texts were counted."""
        tokens = tokenize(by_text(self.texts, "doc_idx", parts=self.parts), "doc_idx")
        counts = parted(term_counts(tokens, "doc_idx"), "doc_idx", self.parts)
        return bucketed(fit_tfidf_in_place(counts, doc_count(self.texts), "doc_idx"), PART, self.parts)

    def cosines(self, pairs: DataFrame, left: str, right: str) -> DataFrame:
        """``pairs`` with the ``similarity`` of their vectors."""
        if self.in_place:
            return pair_cosine(pairs, self.parted_vectors, left, right, "doc_idx", parts=self.parts)
        return pair_cosine(pairs, self.vectors, left, right, "doc_idx")


def pair_set(pairs: DataFrame, materialize: bool = True) -> PairSet:
    return PairSet(pairs, materialize)


def driver_pairs(spark: SparkSession, sf_dir: str) -> PairSet:
    return pair_set(tables.question_pairs(spark, sf_dir))


def pair_similarity(ps: PairSet) -> DataFrame:
    """``(q1idx, q2idx, first_pos, similarity)`` for the last-wins partner of each key."""
    return ps.cosines(ps.last_wins, "q1idx", "q2idx")


def concept_pair_sets(ps: PairSet, encoder_factory, weights_factory, ks: Sequence[int],
                      as_words: bool = False) -> dict[int, PairSet]:
    """The pairs of ``ps`` with vectors over their texts' concepts, one set per ``k``.

    ``as_words`` takes concept ids for words of a text, of which one-digit
    ids are too short.
    """
    bags = ps._kept(concept_bags(ps.texts, "doc_idx", "text", encoder_factory, weights_factory, ks))
    ps.positions  # shared by all sets
    out = {}
    for k in ks:
        counts = concept_counts(bags, "doc_idx", k).withColumn("term", F.col("term").cast("string"))
        if as_words:
            counts = counts.filter(F.length("term") >= 2)
        counts = ps._kept(counts)
        out[k] = copy(ps)
        out[k].in_place = False
        out[k].vectors = ps._kept(tfidf(counts, fit_idf(counts, doc_count(ps.texts)), "doc_idx"))
    return out


def with_pair_texts(scored: DataFrame, ps: PairSet) -> DataFrame:
    """Adds the texts ``q1`` and ``q2`` of the pairs of a (small) list.

    The list is written, so that Spark knows its size: the other texts do not move to meet it.
    """
    scored = ps._kept(scored)
    wanted = scored.select(F.explode(F.array("q1idx", "q2idx")).alias("doc_idx")).distinct()
    texts = ps._kept(ps.texts.join(wanted, "doc_idx", "left_semi"))
    return (scored.join(texts.select(F.col("doc_idx").alias("q1idx"), F.col("text").alias("q1")), "q1idx")
            .join(texts.select(F.col("doc_idx").alias("q2idx"), F.col("text").alias("q2")), "q2idx"))


def query_scores(ps: PairSet, above: float | None = None) -> DataFrame:
    """Similarity of every query (key of the symmetric map) to every text.

    With ``above`` only pairs that may exceed it are produced (exact prefix
    filtering); all others have similarity <= ``above``.
    """
    qv = ps.vectors.join(ps.symmetric.select(F.col("qidx").alias("doc_idx")), "doc_idx", "left_semi")
    if above is None:
        sc = cosine_sparse(qv, ps.vectors, "doc_idx", "doc_idx", split_rows=SPLIT_ROWS)
    else:
        sc = cosine_above(qv, ps.vectors, above, "doc_idx", "doc_idx")
    return sc.toDF("qidx", "doc_idx", "score")


def partner_hits(ps: PairSet, thresholds=THRESHOLDS) -> DataFrame:
    """``(qidx, threshold, hit)`` from the pairs of queries and partners alone."""
    own = ps.cosines(ps.symmetric, "qidx", "partner").toDF("qidx", "doc_idx", "score")
    return threshold_hits(own, ps.symmetric, thresholds)


def threshold_tables(ps: PairSet, thresholds=THRESHOLDS, prefix_filter: bool = False):
    """Counts, partner hits, per-query scores and the curve for all thresholds.

    Every text is scored against every other where its vector is read, as block after block of
    texts comes by (``counts_above``); only counts are written, nothing of size texts x texts moves.
    The hits need the partners alone, so they come from their own pairs.
    ``prefix_filter`` joins exact candidates instead; it pays off when the smallest
    threshold is high.
    """
    least = min(thresholds)
    if prefix_filter:
        sc = query_scores(ps, least).filter(F.round("score", 9) > F.lit(float(least)))
        above = threshold_counts(sc, thresholds)
    else:
        above = (counts_above(ps.parted_vectors, ps.symmetric, thresholds, parts=ps.parts) if ps.in_place
                 else counts_above(ps.vectors, ps.symmetric, thresholds))
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    grid = ps.symmetric.select("qidx", thr)
    counts = (grid.join(above, ["qidx", "threshold"], "left")
              .select("qidx", "threshold", F.coalesce("n_above", F.lit(0)).cast("bigint").alias("n_above")))
    hits = partner_hits(ps, thresholds)
    per = threshold_scores(counts, hits)
    return counts, hits, per, threshold_curve(per)
