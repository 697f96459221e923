"""Concept (sparse-autoencoder) queries on the ``embeddings`` stand-in.

Token hidden states = ``embeddings`` rows (one token per ``vec_id``); a
concept document = all tokens of one ``label``; the autoencoder weights come
from ``formula_sae`` (an integer rule, so DuckDB can rebuild the activations).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions.numeric import rounded
from lexiscope.operators.concepts import concept_topk, formula_sae, sae_encode, sae_topk
from lexiscope.operators.tokens import term_counts, tokenize
from lexiscope.operators.util import scalar_count
from lexiscope.operators.weights import concept_strings, fit_idf, tfidf
from lexiscope.plans import tables
from lexiscope.plans.catalog_words import TOKEN_RE
from lexiscope.plans.registry import register

N_CONCEPTS = 128
D_IN = 64
K_DOC = 4
K_QUERY = 16
SWEEP = (1, 4, 16)

ACT_CTES = f"""
acts AS (
  SELECT vec_id, label,
         list_transform(range({N_CONCEPTS}), lambda j: greatest(0.0,
           list_sum(list_transform(range({D_IN}), lambda d:
             CAST(embedding[d + 1] AS DOUBLE) * ((((d * 31 + j * 17) % 101) - 50) / 50.0::DOUBLE)))
           + ((((j * 7) % 11) - 5) / 50.0::DOUBLE))) AS acts
  FROM embeddings),
act_long AS (SELECT vec_id, label, unnest(range({N_CONCEPTS})) AS concept, unnest(acts) AS act FROM acts),
topk AS (SELECT vec_id, label, concept, act,
                row_number() OVER (PARTITION BY vec_id ORDER BY round(act, 6) DESC, concept ASC) AS rank
         FROM act_long QUALIFY rank <= 16)"""


def _w(body: str) -> str:
    return "WITH " + ACT_CTES.strip() + "\n" + body


def _weights():
    return formula_sae(D_IN, N_CONCEPTS)


def activations(spark, sf):
    emb = tables.table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    return sae_encode(emb, "embedding", _weights, ["vec_id", "label"], cache_key="formula_sae")


def topk(spark, sf, k=K_QUERY, min_value=None):
    """Top-k concepts per token, fused with the activation GEMM in one Arrow batch."""
    emb = tables.table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    return sae_topk(emb, "embedding", _weights, k, ["vec_id", "label"], min_value=min_value,
                    cache_key="formula_sae")


def topk_sql_form(spark, sf, k=K_QUERY, min_value=None):
    """The same top-k with array functions over the full activation vectors."""
    return concept_topk(activations(spark, sf), k, ["vec_id", "label"], min_value=min_value)


@register("concept_activations", _w("SELECT vec_id, CAST(concept AS BIGINT) AS concept, round(act, 6) AS act "
                                    "FROM act_long"))
def q_concept_activations(spark, sf):
    a = activations(spark, sf)
    return (a.select("vec_id", F.posexplode("acts").alias("concept", "act"))
            .select("vec_id", F.col("concept").cast("bigint"), rounded("act").alias("act")))


@register("concept_topk", _w("SELECT vec_id, CAST(rank AS BIGINT) AS rank, CAST(concept AS BIGINT) AS concept, "
                             "round(act, 6) AS act FROM topk"))
def q_concept_topk(spark, sf):
    t = topk(spark, sf)
    return t.select("vec_id", "rank", "concept", rounded("act").alias("act"))


@register("concept_topk_filtered", _w("SELECT vec_id, CAST(rank AS BIGINT) AS rank, CAST(concept AS BIGINT) AS concept, "
                                      "round(act, 6) AS act FROM topk WHERE act >= 0.0"))
def q_concept_topk_filtered(spark, sf):
    t = topk_sql_form(spark, sf, min_value=0.0)
    return t.select("vec_id", "rank", "concept", rounded("act").alias("act"))


@register("concept_counts", _w(f"SELECT CAST(label AS BIGINT) AS label, CAST(concept AS BIGINT) AS concept, "
                               f"count(*) AS cnt FROM topk WHERE rank <= {K_DOC} GROUP BY label, concept"))
def q_concept_counts(spark, sf):
    t = topk(spark, sf, K_DOC)
    return term_counts(t.select(F.col("label").cast("bigint").alias("label"), "concept"), "label", "concept")


@register("concept_k_sweep", _w(f"""
SELECT CAST(k AS BIGINT) AS k, CAST(label AS BIGINT) AS label, CAST(concept AS BIGINT) AS concept, count(*) AS cnt
FROM topk, (SELECT unnest([{', '.join(map(str, SWEEP))}]) AS k) ks WHERE rank <= k GROUP BY k, label, concept"""))
def q_concept_k_sweep(spark, sf):
    t = topk(spark, sf, max(SWEEP))
    ks = F.explode(F.array(*[F.lit(k).cast("bigint") for k in SWEEP])).alias("k")
    x = t.select(ks, F.col("label").cast("bigint").alias("label"), "concept", "rank").filter(F.col("rank") <= F.col("k"))
    return x.groupBy("k", "label", "concept").agg(F.count(F.lit(1)).alias("cnt"))


@register("concept_doc_string", _w(f"""
SELECT CAST(label AS BIGINT) AS label, term, count(*) AS cnt FROM (
  SELECT label, unnest(regexp_extract_all(s, '{TOKEN_RE}')) AS term
  FROM (SELECT vec_id, label, string_agg(CAST(concept AS VARCHAR), ' ' ORDER BY rank) AS s
        FROM topk WHERE rank <= {K_DOC} GROUP BY vec_id, label))
GROUP BY label, term"""))
def q_concept_doc_string(spark, sf):
    t = topk(spark, sf, K_DOC)
    per_token = (t.groupBy("vec_id", "label")
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))),
                                  lambda s: s["concept"]).alias("concepts")))
    strings = concept_strings(per_token, "vec_id", "concepts").join(per_token.select("vec_id", "label"), "vec_id")
    toks = tokenize(strings.select(F.col("label").cast("bigint").alias("label"), "text"), "label", "text")
    return term_counts(toks, "label")


@register("concept_tfidf_query", "WITH " + ACT_CTES.strip() + f"""
, docs AS (SELECT label, concept, count(*) AS cnt FROM topk WHERE rank <= {K_DOC} GROUP BY label, concept),
n AS (SELECT CAST(count(DISTINCT label) AS DOUBLE) AS n FROM docs),
idf AS (SELECT concept, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM docs, n GROUP BY concept, n),
qtf AS (SELECT vec_id, concept, count(*) AS cnt FROM topk GROUP BY vec_id, concept),
qraw AS (SELECT q.vec_id, q.concept, q.cnt * coalesce(i.idf, ln(1.0 + n.n) + 1.0) AS w
         FROM qtf q LEFT JOIN idf i USING (concept), n),
qv AS (SELECT vec_id, concept, w / sqrt(sum(w * w) OVER (PARTITION BY vec_id)) AS weight FROM qraw)
SELECT vec_id, CAST(concept AS BIGINT) AS concept, round(weight, 6) AS weight FROM qv""")
def q_concept_tfidf_query(spark, sf):
    t = topk(spark, sf, K_QUERY)
    docs = term_counts(t.filter(F.col("rank") <= K_DOC).select("label", "concept"), "label", "concept")
    n = scalar_count(docs.select("label").distinct())
    idf = fit_idf(docs, n, "concept")
    q = term_counts(t.select("vec_id", "concept"), "vec_id", "concept")
    v = tfidf(q, idf, "vec_id", "concept", vocabulary="fixed", n_docs=n)
    return v.select("vec_id", "concept", rounded("weight").alias("weight"))
