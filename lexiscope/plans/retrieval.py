"""Ranked retrieval: word TF-IDF index, scoring, ranking and precision@n.

This is the evaluation chain of the reference (collection + topics +
judgments -> precision at 1/3/5/10 per query, mean, best/worst, report),
expressed as one lazy plan per method.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import TOKEN_PATTERN
from lexiscope.operators.judgments import contains_judgments
from lexiscope.operators.ranking import (
    mean_precision, precision_at, rank_docs, ranked_hits, relevant,
)
from lexiscope.operators.similarity import cosine_sparse
from lexiscope.operators.tokens import PART, by_text, parted, remove_stopwords, term_counts, text_parts, tokenize
from lexiscope.operators.util import bucketed, checkpointed
from lexiscope.operators.weights import doc_count, fit_idf, fit_tfidf_in_place, tfidf
from lexiscope.plans import tables
from lexiscope.sources.store import corpus_digest, publish, published, settings_digest

NS = (1, 3, 5, 10)

# A short English function-word list used as the stop-word *parameter* of the
# driver queries (callers pass their own list, e.g. a library's full list).
SHORT_STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to "
    "was were will with"
).split()


#: tasks of ``by_text`` whose counts share a part: a term's sums move once per part
TASKS_PER_PART = 4


class WordIndex:
    """Word TF-IDF of a collection and its queries, built table by table as they are used.

    The term counts feed the idf, the weights and the judgments: they are
    written once to the shared folder when first asked for (``materialize``),
    which also cuts the lineage.  Everything else is a lazy plan over them.
    With ``store`` the counts are published under that path and read back by later
    runs over the same corpus with the same settings (``store_key``).
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, vocabulary: str = "learned", doc_col: str = "doc_id",
                 query_col: str = "query_id", query_text_col: str = "query_text", stopwords=None,
                 materialize: bool = True, store: str | None = None, base: "WordIndex | None" = None):
        self.docs, self.queries, self.vocabulary = docs, queries, vocabulary
        self.doc_col, self.query_col, self.query_text_col = doc_col, query_col, query_text_col
        self.stopwords, self.materialize, self.store, self.base = stopwords, materialize, store, base
        self.n_docs = doc_count(docs)

    def _listed(self, terms: DataFrame) -> DataFrame:
        return terms if self.stopwords is None else remove_stopwords(terms, self.stopwords)

    def _counts(self, tasks: int | None = None) -> DataFrame:
        texts = by_text(self.docs, self.doc_col, parts=tasks)
        return term_counts(self._listed(tokenize(texts, self.doc_col)), self.doc_col)

    def store_key(self) -> str:
        """Names what the stored counts were made from: corpus, token pattern and stop words."""
        words = self.stopwords
        if isinstance(words, DataFrame):
            listed = corpus_digest(words, words.columns[0])
        else:
            listed = None if words is None else sorted({str(w).lower() for w in words})
        return settings_digest(corpus=corpus_digest(self.docs, self.doc_col, "text"), id=self.doc_col, tokens=TOKEN_PATTERN,
                               stopwords=listed)

    @cached_property
    def doc_counts(self) -> DataFrame:
        if self.base is not None:  # words leave a bag by their rows: nothing is tokenised again
            return self._listed(self.base.doc_counts)
        if self.store is not None:
            path, key = f"{self.store}/counts", self.store_key()
            found = published(self.docs.sparkSession, path, key)
            return publish(self._counts(), path, key) if found is None else found
        return self.parted_counts[0].select(self.doc_col, "term", "cnt") if self.materialize else self._counts()

    @cached_property
    def in_place(self) -> bool:
        """Whether the counts lie in parts, so that their weights need not move."""
        return self.materialize and self.store is None and (self.base is None or self.base.in_place)

    @cached_property
    def parted_counts(self) -> tuple[DataFrame, int]:
        """The counts with their ``PART``, written in buckets of it, and the number of parts."""
        if self.base is not None:
            counts, parts = self.base.parted_counts
            return self._listed(counts), parts
        tasks = text_parts(self.docs)
        parts = max(-(-tasks // TASKS_PER_PART), self.docs.sparkSession.sparkContext.defaultParallelism)
        # a multiple of the parts, so that a counting task writes to one part
        return parted(self._counts(parts * -(-tasks // parts)), self.doc_col, parts), parts

    @cached_property
    def query_counts(self) -> DataFrame:
        if self.base is not None:
            return self._listed(self.base.query_counts)
        tokens = tokenize(self.queries, self.query_col, self.query_text_col)
        return term_counts(self._listed(tokens), self.query_col)

    @cached_property
    def idf(self) -> DataFrame:
        idf = fit_idf(self.doc_counts, self.n_docs)  # weights, query vectors and judgments read it
        return checkpointed(idf) if self.materialize else idf

    @cached_property
    def doc_raw(self) -> DataFrame:
        return tfidf(self.doc_counts, self.idf, self.doc_col, norm=None)

    @cached_property
    def placed_vectors(self) -> DataFrame:
        """``doc_vectors`` with their ``PART``, weighted where their counts lie."""
        counts, parts = self.parted_counts
        return fit_tfidf_in_place(counts, self.n_docs, self.doc_col, parts=parts)

    @cached_property
    def doc_vectors(self) -> DataFrame:
        if self.in_place:
            return self.placed_vectors.select(self.doc_col, "term", "weight")
        return tfidf(self.doc_counts, self.idf, self.doc_col)

    def parted_vectors(self) -> tuple[DataFrame, int]:
        """``placed_vectors`` written in buckets of their ``PART``, and the number of parts."""
        parts = self.parted_counts[1]
        return bucketed(self.placed_vectors, PART, parts), parts

    @cached_property
    def query_vectors(self) -> DataFrame:
        return tfidf(self.query_counts, self.idf, self.query_col, vocabulary=self.vocabulary, n_docs=self.n_docs)


def word_index(docs: DataFrame, queries: DataFrame, **options) -> WordIndex:
    """Fit word TF-IDF on ``docs`` and transform ``queries`` with it (nothing runs before a table is used)."""
    return WordIndex(docs, queries, **options)


def without_stopwords(ix: WordIndex, stopwords) -> WordIndex:
    """The same index refitted without ``stopwords`` over the counts of ``ix`` (``n`` is unchanged)."""
    return WordIndex(ix.docs, ix.queries, ix.vocabulary, ix.doc_col, ix.query_col, ix.query_text_col, stopwords,
                     ix.materialize, base=ix)


def driver_index(spark: SparkSession, sf_dir: str, stopwords=None, vocabulary: str = "learned") -> WordIndex:
    return word_index(tables.documents(spark, sf_dir), tables.queries(spark, sf_dir),
                      stopwords=stopwords, vocabulary=vocabulary)


def scores(ix: WordIndex, best: int | None = None) -> DataFrame:
    """Scores of the pairs that share a word; with ``best`` at least the ``best`` highest of every query."""
    if ix.in_place:
        return cosine_sparse(ix.query_vectors, ix.placed_vectors, "query_id", "doc_id", best=best, part_col=PART)
    return cosine_sparse(ix.query_vectors, ix.doc_vectors, "query_id", "doc_id", best=best)


def judgments(ix: WordIndex, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in judgments: documents containing the whole benchmark passage.

    Built from the *unfiltered* word index (stop words must not hide the
    interior words used as join keys).
    """
    passages = tables.table(spark, sf_dir, "benchmark", "item_id", "text")
    return contains_judgments(ix.docs, passages, ix.doc_counts, ix.idf)


def ranked(ix: WordIndex, n: int = 10) -> DataFrame:
    return rank_docs(scores(ix, n), n, ix.queries, ix.docs, "query_id", "doc_id", "score")


def per_query_precision(ix: WordIndex, qrels: DataFrame, n: int = 10) -> DataFrame:
    hits = ranked_hits(ranked(ix, n), relevant(qrels), "query_id", "doc_id")
    return precision_at(hits, ix.queries, NS, "query_id")


def evaluate(spark: SparkSession, sf_dir: str, stopwords=None) -> tuple[DataFrame, DataFrame]:
    """(per-query precision, mean precision) for one word method."""
    ix = driver_index(spark, sf_dir, stopwords=stopwords)
    base = ix if stopwords is None else driver_index(spark, sf_dir)
    per = per_query_precision(ix, judgments(base, spark, sf_dir))
    return per, mean_precision(per, NS)


def evaluate_collection(docs: DataFrame, queries: DataFrame, qrels: DataFrame, stopwords=None,
                        vocabulary: str = "learned", n: int = 10, ns=NS,
                        materialize: bool = False, store: str | None = None):
    """Word TF-IDF evaluation of a collection read from files.

    ``docs``: ``(doc_id string, doc_idx bigint, text)``; ``queries``:
    ``(query_id, query_text)``; ``qrels``: ``(topic, iter, docno, relevancy)``.
    Vectors are keyed by ``doc_idx`` (ties rank the higher position first);
    judgments are matched on the document id string.  ``store`` keeps the fitted
    counts for later runs over the same collection.

    Returns ``(ranked, per_query, mean)``; ``ranked`` carries ``docno``.
    """
    keyed = docs.select(F.col("doc_idx").alias("doc_id"), "text")
    ix = word_index(keyed, queries, stopwords=stopwords, vocabulary=vocabulary,
                    materialize=materialize, store=store)
    r = rank_docs(scores(ix, n), n, ix.queries, keyed, "query_id", "doc_id", "score")
    r = r.join(docs.select(F.col("doc_idx").alias("doc_id"), F.col("doc_id").alias("docno")), "doc_id")
    rel = relevant(qrels).select(F.col("topic").alias("query_id"), F.col("docno"), F.lit(1).alias("hit"))
    hits = (r.join(rel, ["query_id", "docno"], "left")
            .withColumn("hit", F.coalesce("hit", F.lit(0)).cast("bigint")))
    per = precision_at(hits, ix.queries, ns, "query_id")
    return r, per, mean_precision(per, ns)
