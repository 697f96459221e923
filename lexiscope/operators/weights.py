"""TF-IDF fitting and transformation over long ``(id, term, cnt)`` tables.

Semantics (smooth idf, raw counts, L2 rows, zero rows stay zero):

* ``idf(t) = ln((1 + n) / (1 + df(t))) + 1`` with ``n`` = all fitted documents,
  empty ones included;
* ``weight = cnt * idf``, then each row is divided by its L2 norm.

Two vocabulary modes:

* ``learned`` - the vocabulary is the set of terms seen while fitting; unseen
  query terms are dropped (inner join to the idf table);
* ``fixed`` - the vocabulary is fixed in advance (concept ids); an unseen term
  keeps ``idf = ln(1 + n) + 1`` and stays in the query vector (left join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.numeric import smooth_idf
from lexiscope.operators.util import scalar_count


def doc_count(docs: DataFrame) -> Column:
    """Number of fitted documents as a scalar column."""
    return scalar_count(docs)


def fit_idf(counts: DataFrame, n_docs: Column, term_col: str = "term") -> DataFrame:
    """``(term, df, idf)`` from a ``(id, term, cnt)`` table (one row per id and term)."""
    return (counts.groupBy(term_col)
            .agg(F.count(F.lit(1)).alias("df"))
            .withColumn("idf", smooth_idf("df", n_docs)))


def tfidf(counts: DataFrame, idf: DataFrame, id_col: str = "doc_id", term_col: str = "term",
          vocabulary: str = "learned", n_docs: Column | None = None,
          norm: str | None = "l2") -> DataFrame:
    """``(id, term, weight)``: counts weighted by idf, optionally L2-normalised."""
    idf_side = idf.select(term_col, "idf")
    if vocabulary == "learned":
        w = counts.join(idf_side, term_col, "inner")
        idf_col = F.col("idf")
    elif vocabulary == "fixed":
        if n_docs is None:
            raise ValueError("vocabulary='fixed' needs n_docs for unseen terms")
        w = counts.join(idf_side, term_col, "left")
        idf_col = F.coalesce(F.col("idf"), smooth_idf(F.lit(0), n_docs))
    else:
        raise ValueError(f"unknown vocabulary mode {vocabulary!r}")
    w = w.select(id_col, term_col, (F.col("cnt").cast("double") * idf_col).alias("weight"))
    if norm == "l2":
        return l2_normalize(w, id_col)
    if norm is None:
        return w
    raise ValueError(f"unknown norm {norm!r}")


def l2_normalize(weights: DataFrame, id_col: str = "doc_id", weight_col: str = "weight") -> DataFrame:
    """Divide each row's weights by the row's L2 norm.

    One exchange by id: a vector has at most one row per term of the
    vocabulary, so a window over it is bounded (and spills) however long the
    text was.
    """
    from pyspark.sql import Window

    w = F.col(weight_col)
    return weights.withColumn(weight_col, w / F.sqrt(F.sum(w * w).over(Window.partitionBy(id_col))))


def fit_tfidf_in_place(counts: DataFrame, n_docs: Column, id_col: str = "doc_id", term_col: str = "term",
                       parts: int | None = None) -> DataFrame:
    """``(PART, id, term, weight)``: L2 weights of counts ``parted`` by id, by an idf fitted on them.

    No count moves: each part gives its distinct terms with their documents, and
    gets back their idf.  Both are as many rows as the parts have distinct terms.
    ``parts`` is needed where they may be fewer than the shuffle partitions.
    """
    from pyspark.sql import Window

    from lexiscope.operators.tokens import PART

    local = counts.groupBy(PART, term_col).agg(F.count(F.lit(1)).alias("_n"))
    # a term has at most one row per part: its rows meet once, for the sum and for the way back
    given = (local.withColumn("df", F.sum("_n").over(Window.partitionBy(term_col))).withColumn("_docs", n_docs)
             .select(PART, term_col, smooth_idf("df", "_docs").alias("idf")))
    if parts is not None:
        given = given.repartition(parts, PART)
    # the terms of a part are held by its task, so its counts need not be sorted by term
    w = (counts.join(given.hint("shuffle_hash"), [term_col, PART])
         .select(PART, id_col, term_col, (F.col("cnt").cast("double") * F.col("idf")).alias("weight")))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col, PART)))
    return w.withColumn("weight", F.col("weight") / norm)


def fit_transform(counts: DataFrame, n_docs: Column, id_col: str = "doc_id",
                  term_col: str = "term") -> tuple[DataFrame, DataFrame]:
    """Fit idf on ``counts`` and return ``(idf, l2 weights of the fitted rows)``."""
    idf = fit_idf(counts, n_docs, term_col)
    return idf, tfidf(counts, idf, id_col, term_col)


def concept_strings(concepts: DataFrame, id_col: str = "doc_id", items_col: str = "concepts",
                    text_col: str = "text") -> DataFrame:
    """Render concept ids as a blank-joined string (a "concept document").

    Re-tokenised with the word pattern, ids 0-9 vanish (one-character tokens);
    the count path (``bag_counts``) keeps them.
    """
    return concepts.select(id_col, F.array_join(F.transform(items_col, lambda x: x.cast("string")), " ")
                           .alias(text_col))
