"""Word TF-IDF retrieval queries over the driver tables (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions.numeric import rounded
from lexiscope.functions.text import snippet
from lexiscope.operators.groups import with_positions
from lexiscope.operators.ranking import (
    best_worst, mean_precision, precision_at, rank_docs, ranked_hits, relevant,
    top_doc_detail, top_n_per_group, top_n_strings,
)
from lexiscope.operators.similarity import cosine_distance
from lexiscope.operators.tokens import remove_stopwords, tokenize
from lexiscope.plans import retrieval as R
from lexiscope.plans import tables
from lexiscope.plans.registry import register

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
STOP_SQL = ", ".join(f"'{w}'" for w in R.SHORT_STOPWORDS)


def word_ctes(stop: bool = False, p: str = "") -> str:
    """DuckDB CTEs for the word index, scores, judgments and zero-filled top 10.

    ``p`` prefixes every CTE name so two methods can share one statement.
    """
    sw = f" WHERE term NOT IN ({STOP_SQL})" if stop else ""
    return f"""
{p}doc_tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS term FROM documents),
{p}doc_tf AS (SELECT doc_id, term, count(*) AS cnt FROM {p}doc_tok{sw} GROUP BY doc_id, term),
{p}n_docs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
{p}idf AS (SELECT term, count(*) AS df, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf
        FROM {p}doc_tf, {p}n_docs GROUP BY term, n),
{p}doc_raw AS (SELECT doc_id, term, cnt * idf AS w FROM {p}doc_tf JOIN {p}idf USING (term)),
{p}doc_v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {p}doc_raw),
{p}q_tok AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS term FROM benchmark),
{p}q_tf AS (SELECT query_id, term, count(*) AS cnt FROM {p}q_tok{sw} GROUP BY query_id, term),
{p}q_raw AS (SELECT query_id, term, cnt * idf AS w FROM {p}q_tf JOIN {p}idf USING (term)),
{p}q_v AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM {p}q_raw),
{p}scores AS (SELECT q.query_id, d.doc_id, sum(q.weight * d.weight) AS score
           FROM {p}q_v q JOIN {p}doc_v d USING (term) GROUP BY q.query_id, d.doc_id),
{p}fill AS (SELECT b.item_id AS query_id, t.doc_id, 0.0::DOUBLE AS score
         FROM benchmark b, (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10) t),
{p}cand AS (SELECT query_id, doc_id, max(score) AS score
         FROM (SELECT * FROM {p}scores UNION ALL SELECT * FROM {p}fill) u GROUP BY query_id, doc_id),
{p}ranked AS (SELECT query_id, doc_id, score,
                  row_number() OVER (PARTITION BY query_id
                                     ORDER BY round(score, 9) DESC, score > 0 DESC, doc_id DESC) AS rank
           FROM {p}cand QUALIFY rank <= 10),
{p}judg AS (SELECT b.item_id AS topic, d.doc_id AS docno, 1 AS relevancy
         FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
{p}hits AS (SELECT r.query_id, r.doc_id, r.rank, CASE WHEN j.docno IS NULL THEN 0 ELSE 1 END AS hit
         FROM {p}ranked r LEFT JOIN (SELECT DISTINCT topic, docno FROM {p}judg WHERE relevancy = 1) j
           ON r.query_id = j.topic AND r.doc_id = j.docno),
{p}perq AS (SELECT b.item_id AS query_id,
                coalesce(CAST(sum(CASE WHEN rank <= 1 THEN hit ELSE 0 END) AS DOUBLE) / 1, 0.0) AS precision_at_1,
                coalesce(CAST(sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) AS DOUBLE) / 3, 0.0) AS precision_at_3,
                coalesce(CAST(sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS DOUBLE) / 5, 0.0) AS precision_at_5,
                coalesce(CAST(sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS DOUBLE) / 10, 0.0) AS precision_at_10
         FROM benchmark b LEFT JOIN {p}hits h ON h.query_id = b.item_id GROUP BY b.item_id)"""


def _with(body: str, stop: bool = False) -> str:
    return "WITH " + word_ctes(stop).strip() + "\n" + body


# ---------------------------------------------------------------- T1, T2, P12

@register("tokenize", f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM (
  SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_RE}') AS t FROM documents))
""")
def q_tokenize(spark, sf):
    return tokenize(tables.documents(spark, sf))


@register("stopword_filter", f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM (
  SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_RE}') AS t FROM documents))
WHERE term NOT IN ({STOP_SQL})
""")
def q_stopword_filter(spark, sf):
    return remove_stopwords(tokenize(tables.documents(spark, sf)), R.SHORT_STOPWORDS)


@register("truncate_tokens", f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM (
  SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_RE}')[1:90] AS t FROM documents))
""")
def q_truncate_tokens(spark, sf):
    return tokenize(tables.documents(spark, sf), max_tokens=90)


# ---------------------------------------------------------------- T3-T8

@register("term_counts", _with("SELECT doc_id, term, CAST(cnt AS BIGINT) AS cnt FROM doc_tf"))
def q_term_counts(spark, sf):
    return R.driver_index(spark, sf).doc_counts


@register("vocabulary", _with("SELECT q.query_id, q.term, CAST(q.cnt AS BIGINT) AS cnt "
                              "FROM q_tf q JOIN idf USING (term)"))
def q_vocabulary(spark, sf):
    ix = R.driver_index(spark, sf)
    return ix.query_counts.join(ix.idf.select("term"), "term").select("query_id", "term", "cnt")


@register("doc_freq_idf", _with("SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf"))
def q_doc_freq_idf(spark, sf):
    ix = R.driver_index(spark, sf)
    return ix.idf.select("term", F.col("df").cast("bigint"), rounded("idf").alias("idf"))


@register("tfidf_raw", _with("SELECT doc_id, term, round(w, 6) AS weight FROM doc_raw"))
def q_tfidf_raw(spark, sf):
    ix = R.driver_index(spark, sf)
    return ix.doc_raw.select("doc_id", "term", rounded("weight").alias("weight"))


@register("tfidf_l2", _with("SELECT doc_id, term, round(weight, 6) AS weight FROM doc_v"))
def q_tfidf_l2(spark, sf):
    ix = R.driver_index(spark, sf)
    return ix.doc_vectors.select("doc_id", "term", rounded("weight").alias("weight"))


@register("tfidf_query", _with("SELECT query_id, term, round(weight, 6) AS weight FROM q_v"))
def q_tfidf_query(spark, sf):
    ix = R.driver_index(spark, sf)
    return ix.query_vectors.select("query_id", "term", rounded("weight").alias("weight"))


# ---------------------------------------------------------------- C1, C4

@register("cosine_sparse", _with("SELECT query_id, doc_id, round(score, 6) AS score FROM scores"))
def q_cosine_sparse(spark, sf):
    s = R.scores(R.driver_index(spark, sf))
    return s.select("query_id", "doc_id", rounded("score").alias("score"))


@register("cosine_distance", _with("SELECT query_id, doc_id, round(1.0 - score, 6) AS distance FROM scores"))
def q_cosine_distance(spark, sf):
    s = cosine_distance(R.scores(R.driver_index(spark, sf)))
    return s.select("query_id", "doc_id", rounded("distance").alias("distance"))


# ---------------------------------------------------------------- R1-R3

@register("rank_docs", _with("""
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, score > 0 DESC, doc_id DESC) AS rank
  FROM scores) WHERE rank <= 10"""))
def q_rank_docs(spark, sf):
    r = rank_docs(R.scores(R.driver_index(spark, sf), 10), 10)
    return r.select("query_id", "doc_id", rounded("score").alias("score"), "rank")


@register("topn_docs", _with("""
SELECT CAST(n AS BIGINT) AS n, query_id, doc_id, CAST(rank AS BIGINT) AS rank
FROM ranked, (SELECT unnest([1, 3, 5, 10]) AS n) ns WHERE rank <= n"""))
def q_topn_docs(spark, sf):
    r = R.ranked(R.driver_index(spark, sf), 10)
    ns = F.explode(F.array(*[F.lit(n).cast("bigint") for n in R.NS])).alias("n")
    return r.select(ns, "query_id", "doc_id", "rank").filter(F.col("rank") <= F.col("n"))


@register("rank_zero_fill", _with("""
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM ranked"""))
def q_rank_zero_fill(spark, sf):
    r = R.ranked(R.driver_index(spark, sf), 10)
    return r.select("query_id", "doc_id", rounded("score").alias("score"), "rank")


# ---------------------------------------------------------------- P9, J4, R4-R8, P10

@register("qrels_filter", _with("SELECT DISTINCT topic, docno FROM judg WHERE relevancy = 1"))
def q_qrels_filter(spark, sf):
    ix = R.driver_index(spark, sf)
    return relevant(R.judgments(ix, spark, sf))


@register("ranked_hits", _with("SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, "
                               "CAST(hit AS BIGINT) AS hit FROM hits"))
def q_ranked_hits(spark, sf):
    ix = R.driver_index(spark, sf)
    h = ranked_hits(R.ranked(ix), relevant(R.judgments(ix, spark, sf)))
    return h.select("query_id", "doc_id", "rank", "hit")


PREC_COLS = "query_id, " + ", ".join(f"round(precision_at_{n}, 6) AS precision_at_{n}" for n in R.NS)


def _prec_select(df):
    return df.select("query_id", *[rounded(f"precision_at_{n}").alias(f"precision_at_{n}") for n in R.NS])


@register("precision_at_n", _with(f"SELECT {PREC_COLS} FROM perq"))
def q_precision_at_n(spark, sf):
    ix = R.driver_index(spark, sf)
    return _prec_select(R.per_query_precision(ix, R.judgments(ix, spark, sf)))


@register("mean_precision", _with("SELECT " + ", ".join(
    f"round(avg(precision_at_{n}), 6) AS avg_precision_at_{n}" for n in R.NS) + " FROM perq"))
def q_mean_precision(spark, sf):
    ix = R.driver_index(spark, sf)
    m = mean_precision(R.per_query_precision(ix, R.judgments(ix, spark, sf)))
    return m.select(*[rounded(c).alias(c) for c in m.columns])


@register("best_worst_queries", _with(f"""
SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY precision_at_5 DESC, query_id ASC) AS BIGINT) AS rank,
       {PREC_COLS}
FROM (SELECT 'top' AS kind, * FROM (SELECT * FROM perq ORDER BY precision_at_5 DESC, query_id ASC LIMIT 10)
      UNION ALL
      SELECT 'bottom' AS kind, * FROM (SELECT * FROM perq ORDER BY precision_at_5 ASC, query_id DESC LIMIT 10))"""))
def q_best_worst_queries(spark, sf):
    ix = R.driver_index(spark, sf)
    bw = best_worst(R.per_query_precision(ix, R.judgments(ix, spark, sf)))
    return bw.select("kind", "rank", *_prec_select(bw).columns[0:1],
                     *[rounded(f"precision_at_{n}").alias(f"precision_at_{n}") for n in R.NS])


@register("top_doc_detail", _with("""
SELECT r.query_id, b.text AS query_text, r.doc_id AS top_doc_id,
       CASE WHEN length(d.text) > 500 THEN substr(d.text, 1, 500) || '...' ELSE d.text END AS top_doc_text
FROM ranked r JOIN documents d ON d.doc_id = r.doc_id JOIN benchmark b ON b.item_id = r.query_id
WHERE r.rank = 1"""))
def q_top_doc_detail(spark, sf):
    ix = R.driver_index(spark, sf)
    return top_doc_detail(R.ranked(ix), ix.docs, ix.queries)


@register("top10_strings", _with("""
SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS top_doc_id,
       string_agg(snip, '|' ORDER BY rank) AS top_doc_text
FROM (SELECT r.query_id, r.doc_id, r.rank,
             CASE WHEN length(d.text) > 500 THEN substr(d.text, 1, 500) || '...' ELSE d.text END AS snip
      FROM ranked r JOIN documents d ON d.doc_id = r.doc_id)
GROUP BY query_id"""))
def q_top10_strings(spark, sf):
    ix = R.driver_index(spark, sf)
    return top_n_strings(R.ranked(ix), ix.docs, 10)


@register("text_snippet", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet
FROM documents""")
def q_text_snippet(spark, sf):
    return tables.documents(spark, sf).select("doc_id", snippet("text").alias("snippet"))


# ---------------------------------------------------------------- R10 / K2

_CMP_SQL = ("WITH " + word_ctes(False).strip() + ",\n" + word_ctes(True, "s_").strip() + "\n" + """
SELECT metric, round(bag_of_words, 6) AS bag_of_words, round(bag_of_words_stopwords, 6) AS bag_of_words_stopwords
FROM (SELECT 'avg_precision_at_1' AS metric, (SELECT avg(precision_at_1) FROM perq) AS bag_of_words,
             (SELECT avg(precision_at_1) FROM s_perq) AS bag_of_words_stopwords
      UNION ALL SELECT 'avg_precision_at_3', (SELECT avg(precision_at_3) FROM perq), (SELECT avg(precision_at_3) FROM s_perq)
      UNION ALL SELECT 'avg_precision_at_5', (SELECT avg(precision_at_5) FROM perq), (SELECT avg(precision_at_5) FROM s_perq)
      UNION ALL SELECT 'avg_precision_at_10', (SELECT avg(precision_at_10) FROM perq), (SELECT avg(precision_at_10) FROM s_perq))""")


@register("method_comparison", _CMP_SQL)
def q_method_comparison(spark, sf):
    from lexiscope.operators.report import compare_methods

    ix = R.driver_index(spark, sf)
    judg = R.judgments(ix, spark, sf)
    sx = R.without_stopwords(ix, R.SHORT_STOPWORDS)
    means = {
        "bag_of_words": mean_precision(R.per_query_precision(ix, judg)),
        "bag_of_words_stopwords": mean_precision(R.per_query_precision(sx, judg)),
    }
    cmp = compare_methods(means)
    return cmp.select("metric", *[rounded(m).alias(m) for m in means])


# ---------------------------------------------------------------- P3

@register("doc_positions", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_idx FROM documents""")
def q_doc_positions(spark, sf):
    return with_positions(tables.documents(spark, sf).select("doc_id"), "doc_id")
