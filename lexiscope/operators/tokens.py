"""Tokenising and term counting (word bags and concept bags)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import tokens as token_array
from lexiscope.operators.util import bucketed


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             max_tokens: int | None = None, min_len: int = 2) -> DataFrame:
    """One row per token: ``(id, pos, term)``; empty texts emit no rows.

    ``max_tokens`` keeps only the first tokens of each text (the encoder's
    truncation length); the default keeps the whole text.  A projection: no shuffle.
    """
    toks = token_array(text_col, min_len)
    if max_tokens is not None:
        toks = F.slice(toks, 1, int(max_tokens))
    return (df.select(F.col(id_col), F.posexplode(toks).alias("pos", "term"))
              .withColumn("pos", F.col("pos").cast("bigint")))


def truncate_tokens(token_rows: DataFrame, max_tokens: int, pos_col: str = "pos") -> DataFrame:
    """Keep positions ``< max_tokens`` of an exploded token table."""
    return token_rows.filter(F.col(pos_col) < F.lit(int(max_tokens)))


def remove_stopwords(token_rows: DataFrame, stopwords, term_col: str = "term") -> DataFrame:
    """Drop tokens found in ``stopwords`` (a Python collection or a one-column DataFrame), lower-cased.

    One anti join whatever the size of the list; Spark broadcasts a list that
    its statistics show to be small.
    """
    if not isinstance(stopwords, DataFrame):
        listed = "\n".join(sorted({str(w) for w in stopwords}))  # no token holds a line break
        stopwords = (token_rows.sparkSession.range(1)
                     .select(F.explode(F.split(F.lit(listed), "\n")).alias(term_col)))
    words = stopwords.select(F.lower(F.col(stopwords.columns[0])).alias(term_col))
    return token_rows.join(words, term_col, "left_anti").select(*token_rows.columns)


#: text of one task that counts terms: its hash tables take about 20 times that
TASK_BYTES = 8 << 20


def by_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES,
            parts: int | None = None) -> DataFrame:
    """Texts dealt by id, for counts per id: they move once as texts and no more as counts.

    The exchange also spreads a table that is one large row group, and the
    counts per ``(id, term)`` need no further one.  The number of parts follows the
    measured bytes, so a task counts about ``task_bytes`` of text however large the table.
    """
    return df.select(id_col, text_col).repartition(parts or text_parts(df, text_col, task_bytes), id_col)


def text_parts(df: DataFrame, text_col: str = "text", task_bytes: int = TASK_BYTES) -> int:
    """How many parts ``by_text`` makes."""
    size = df.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    return max(-(-size // task_bytes), df.sparkSession.sparkContext.defaultParallelism)


#: the part of a row in tables that stay in place
PART = "_part"


@lru_cache
def part_names(parts: int) -> tuple[int, ...]:
    """A number for each part, which is the least that its own bucket takes: no two parts share a bucket."""
    spark, most = SparkSession.builder.getOrCreate(), 16 * parts
    while True:
        numbers = spark.range(most).select(F.col("id").cast("int").alias("name"))
        named = (numbers.groupBy(F.pmod(F.hash("name"), F.lit(parts)).alias("bucket"))
                 .agg(F.min("name").alias("name")).orderBy("bucket").collect())
        if len(named) == parts:
            return tuple(r["name"] for r in named)
        most *= 4


def part_of(id_col: str | Column, parts: int) -> Column:
    """The part that ``by_text`` puts an id into."""
    names = F.array(*[F.lit(n) for n in part_names(parts)])
    return F.get(names, F.pmod(F.hash(id_col), F.lit(parts)))


def parted(counts: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``counts`` with their ``PART``, written once in buckets of it: what joins or groups on it leaves them in place."""
    counts.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return bucketed(counts.withColumn(PART, part_of(id_col, parts)), PART, parts)


def term_counts(token_rows: DataFrame, id_col: str = "doc_id", term_col: str = "term") -> DataFrame:
    """``(id, term, cnt)``; the partial aggregate collapses repeats before the shuffle."""
    return (token_rows.groupBy(id_col, term_col)
            .agg(F.count(F.lit(1)).alias("cnt")))


def bag_counts(df: DataFrame, id_col: str, items_col: str, term_col: str = "term") -> DataFrame:
    """Counts of an array column (e.g. concept ids per document), duplicates counted."""
    return term_counts(df.select(id_col, F.explode(items_col).alias(term_col)), id_col, term_col)


def load_stopwords(spark, path: str) -> DataFrame:
    """A stop-word table from a text file, one word per line."""
    return (spark.read.text(path)
            .select(F.lower(F.trim("value")).alias("term"))
            .filter(F.length("term") > 0).distinct())
