"""Language identification by Bayesian evidence fusion.

A page's posterior is the product of four pieces of evidence:

* text: all visible text, that inside articles counting ``ARTICLE`` times more, under
  a naive Bayes model of hashed byte trigrams, trained on a bounded
  sample of labelled texts (``sample_per_language`` documents of each language,
  chosen by a hash of their id), tempered because neighbouring trigrams depend
  on each other;
* the language that the markup declares and the address suffix: likelihoods
  estimated from all pages by grouped sums of the text posteriors;
* a host prior, smoothed by its domain's prior, which is smoothed by the
  distribution over all pages; a page's own text is taken out of its own host
  and domain sums.

Sums are arrays of one number per language, pre-aggregated before they move,
so a host with a third of all pages is no heavier than others.

Defined results: a null or empty html has no text evidence; without labelled
texts no language is known (text_lang, lang and probability are null); a missing
declaration, suffix or host gives no evidence (the prior over all pages);
of equal posteriors the language first in order wins; repeated rows are judged
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import small_batches, stored, table, utf8

BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE = 500
MAX_LANGUAGES = 200
#: weight of the text's log-likelihood, and the most trigrams that count in full
TEMPER, FULL_TRIGRAMS = 0.3, 400
SMOOTHING = 5.0
#: how often text inside articles counts besides all visible text
ARTICLE = 3
#: parts of a language that are ranked by themselves first
RANK_PARTS = 64

#: elements that hold no running text
_HIDDEN = ("script", "style", "nav", "footer", "noscript")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_BLANK = re.compile(r"\s+")


def visible_text(html: str) -> tuple[str, str]:
    """(all visible text, that inside articles), in one pass over the tags.

    Navigation, scripts, styles and footers are left out if they are closed; what
    follows an unclosed comment or an unfinished tag is no text.
    """
    lower = html.lower()
    if len(lower) != len(html):  # a letter whose lower case is longer: only tag names matter
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), html)
    seen, inside, at, depth, unclosed = [], [], 0, 0, set()
    while True:
        tag = html.find("<", at)
        text = html[at:] if tag < 0 else html[at:tag]
        seen.append(text)
        if depth:
            inside.append(text)
        if tag < 0:
            break
        if html.startswith("<!--", tag):
            stop = html.find("-->", tag + 4)
            if stop < 0:
                break
            at = stop + 3
            continue
        stop, name = html.find(">", tag), _NAME.match(lower, tag)
        if stop < 0:
            break
        at = stop + 1
        if name and name[2] in _HIDDEN and not name[1] and name[2] not in unclosed:
            close = lower.find("</" + name[2], at)
            if close < 0:
                unclosed.add(name[2])  # looked for once, however often it is opened
            else:
                at = close
        elif name and name[2] == "article":
            depth = max(0, depth - 1) if name[1] else depth + 1
    clean = lambda parts: _BLANK.sub(" ", entities.unescape(" ".join(parts))).strip()
    return clean(seen), clean(inside)


def declared_language(html: str) -> str | None:
    start = re.search("<html\\b", html, re.I)
    if not start:
        return None
    stop = html.find(">", start.end())
    m = _LANG.search(html[start.end():stop if stop >= 0 else None].lower())
    return m[1] if m else None


def address_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (the last)."""
    try:
        host = urlsplit(url.strip()).hostname if url else None
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else None


def trigram_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text."""
    b = np.frombuffer(b" " + data.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    key = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(18), minlength=BUCKETS)


class TextModel:
    """Log-probabilities of trigram buckets in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def log_posterior(self, data: bytes, more: bytes = b"") -> np.ndarray:
        """Log of the normalised, tempered text posterior under equal priors; ``more`` counts ``ARTICLE`` times."""
        if not self.languages:
            return np.zeros(0)
        counts = trigram_counts(data) if data else np.zeros(BUCKETS)
        if more:
            counts = counts + ARTICLE * trigram_counts(more)
        n = counts.sum()
        score = self.logp @ counts * (TEMPER * min(1.0, FULL_TRIGRAMS / n) if n else 0.0)
        score -= score.max()
        return score - np.log(np.exp(score).sum())


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_per_language: int = SAMPLE_PER_LANGUAGE) -> TextModel:
    """Fit on the first ``sample_per_language`` texts of each language by a hash of their id.

    The driver receives one count per language and bucket, for the ``MAX_LANGUAGES``
    languages of most texts (equals: by name).  Without labelled texts the model
    knows no language.
    """
    known = (labelled.select(F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
             .groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect())
    if not known:
        return TextModel([], np.zeros((0, BUCKETS)))
    labelled = labelled.filter(F.col(lang_col).cast("string").isin([r["lang"] for r in known]))
    order = [F.xxhash64("id"), F.col("id")]
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(RANK_PARTS))
    chosen = (labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
              .filter("lang is not null and id is not null").distinct()
              # no language is ranked by one task: its first rows are among the first of its parts
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
              .filter(F.col("rank") <= sample_per_language)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
              .filter(F.col("rank") <= sample_per_language))
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                           F.col(text_col).cast("string").alias("text")).join(chosen, ["id", "lang"], "left_semi")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                sums[lang] = sums.get(lang, 0) + trigram_counts(t)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    counts = (rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts.lang.unique())
    matrix = np.zeros((len(languages), BUCKETS))
    matrix[counts.lang.map({x: i for i, x in enumerate(languages)}), counts.bucket] = counts.n
    return TextModel(languages, matrix)


EVIDENCE = "struct<host:string,domain:string,suffix:string,declared:string,text:array<double>>"
_EVIDENCE = pa.struct([("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()),
                       ("declared", pa.string()), ("text", pa.list_(pa.float64()))])


def page_evidence(html: Column, url: Column, model) -> Column:
    """Address parts, declared language and log text posterior of a page; ``model`` is a broadcast TextModel."""
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        out = []
        for h, u in zip(pages.to_pylist(), urls.to_pylist()):
            host, domain, suffix = address_parts(u)
            out.append({"host": host, "domain": domain, "suffix": suffix, "declared": declared_language(h or ""),
                        "text": model.value.log_posterior(*(x.encode(errors="replace") for x in visible_text(h or ""))).tolist()})
        return pa.array(out, _EVIDENCE)

    run.__annotations__ = {"pages": pa.Array, "urls": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, EVIDENCE).asNondeterministic()(html.cast("string"), url.cast("string"))


def _sums(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(name)))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _smoothed(counts: Column, own: Column, prior: Column, weight: float) -> Column:
    """Shares in ``counts`` without ``own``, smoothed towards ``prior``."""
    rest = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    return F.zip_with(rest, prior, lambda c, q: (c + weight * q) / (_total(rest) + weight))


def identify_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html", smoothing: float = SMOOTHING) -> DataFrame:
    """``(page_id, host, declared, text_lang, lang, probability)`` of every page."""
    spark, n = pages.sparkSession, len(model.languages)
    held = spark.sparkContext.broadcast(model)
    names = F.array(*[F.lit(x) for x in model.languages])
    evidence = pages.select(F.col(id_col).alias("page_id"),
                            page_evidence(F.col(html_col), F.col(url_col), held).alias("e"))
    if not n:  # no text evidence, and no languages to choose from
        none = [F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("probability", "double"))]
        return evidence.select("page_id", "e.host", "e.declared", *none)
    facts = stored(evidence.select("page_id", "e.*")
                   .withColumn("p", F.transform("text", lambda x: F.exp(x))))
    everything = facts.agg(*[F.sum(F.col("p")[i]) for i in range(n)]).first()
    total = sum(x or 0.0 for x in everything) + n
    overall = F.array(*[F.lit(((x or 0.0) + 1) / total) for x in everything])
    mass = F.array(*[F.lit(float(x or 0.0)) for x in everything])

    def likelihood(key: str) -> DataFrame:
        """log P(value | language), smoothed by the value's overall share."""
        sums = _sums(facts, key, n, "sums")
        share = _total(F.col("sums")) / F.lit(total)
        logs = F.zip_with("sums", mass, lambda c, m: F.log((c + smoothing * share) / (m + smoothing)))
        return sums.select(F.col(key), logs.alias(f"{key}_log"))

    hosts = _sums(facts, "host", n, "host_sums")
    domains = _sums(facts, "domain", n, "domain_sums")
    zeros = F.array(*[F.lit(0.0)] * n)
    joined = (facts.join(hosts, "host", "left").join(domains, "domain", "left")
              .join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left"))
    domain_prior = F.when(F.col("domain_sums").isNull(), overall).otherwise(
        _smoothed(F.col("domain_sums"), F.col("p"), overall, smoothing))
    joined = joined.withColumn("domain_prior", domain_prior)
    host_prior = F.when(F.col("host_sums").isNull(), overall).otherwise(
        _smoothed(F.col("host_sums"), F.col("p"), F.col("domain_prior"), smoothing))
    joined = joined.withColumn("prior", host_prior)
    score = F.col("text")
    for other in (F.transform("prior", lambda x: F.log(x)), F.coalesce("declared_log", zeros), F.coalesce("suffix_log", zeros)):
        score = F.zip_with(score, other, lambda a, b: a + b)
    joined = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    weights = F.transform("score", lambda s: F.exp(s - F.col("top")))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.select("page_id", "host", "declared", best(F.col("text")).alias("text_lang"),
                         best(F.col("score")).alias("lang"), F.round(1 / _total(weights), 6).alias("probability"))


@small_batches
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"))
    return identify_languages(table(spark, sf_dir, "pages"), model)
