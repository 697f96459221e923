"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
with A-Z lower-cased.  A window is ``width`` consecutive words of a benchmark
item; an item with fewer words is one window.  Windows become a hash set that
is broadcast in blocks of a checked size; every task scans the word windows of
whole texts against it, verifies each hit word by word, and reports the words
inside occurrences, which may then be cut out of the text.

Defined results: null texts and texts without words have no windows and no
hits; repeated item ids count once; null item ids are left out of the list of
items but their windows still hit; ties and repeated documents are judged row
by row; empty tables give no rows (no documents) or no hits (no items); other
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import free_name, release_memory, small_batches, stored, table, text_slices

WINDOW_WORDS = 10
#: benchmark text in one broadcast set; larger benchmarks go in several passes
BLOCK_BYTES = 32 << 20
#: A-Z lower-cased; letters, digits and non-ASCII bytes stay; all else parts words
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
             for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """Hash set of item windows over the words of the items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW_WORDS):
        self.words: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in (text or "").encode().translate(FOLD).split()]
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                windows.setdefault(tuple(ids[i:i + n]), set()).update([item] if item is not None else [])
        self.by_length: dict[int, tuple[np.ndarray, dict[tuple[int, ...], set[str]]]] = {}
        for n in sorted({len(w) for w in windows}):
            own = {w: i for w, i in windows.items() if len(w) == n}
            self.by_length[n] = (np.unique(self.hashes(np.array(list(own), np.int64).reshape(-1, n).T)), own)

    @staticmethod
    def hashes(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(31)
        return h

    def scan(self, texts: list[bytes]):
        """Per text: number of words, sorted (start, end) word spans, set of items."""
        folded = [t.translate(FOLD).split() for t in texts]
        sizes = np.array([len(w) for w in folded], np.int64)
        ids = np.fromiter((i for ws in folded for i in map(self.words.get, ws, repeat(-1))), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        offsets = np.cumsum(sizes) - sizes
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        found = [([], set()) for _ in texts]
        for n, (known, windows) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])  # all words known
            at = at[doc[at] == doc[at + n - 1]]
            if not len(at):
                continue
            h = self.hashes([ids[at + k] for k in range(n)])
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in at[known[place] == h].tolist():  # verify each hit
                items = windows.get(tuple(ids[i:i + n].tolist()))
                if items is not None:
                    d = int(doc[i])
                    found[d][0].append((i - int(offsets[d]), i - int(offsets[d]) + n))
                    found[d][1].update(items)
        return [(int(n), merged(spans), items) for n, (spans, items) in zip(sizes, found)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges as sorted, disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


SCAN = "struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
ARROW_SCAN = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def scan_windows(text: Column, windows) -> Column:
    """Struct ``(n_words, spans, items)`` of a text against a broadcast ``WindowSet``."""
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_slices(texts):
            out += [{"n_words": n, "spans": [{"start": s, "stop": e} for s, e in spans], "items": sorted(items)}
                    for n, spans, items in windows.value.scan(part)]
        release_memory()
        return pa.array(out, ARROW_SCAN)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SCAN).asNondeterministic()(text.cast("string"))


def with_hits(docs: DataFrame, items: DataFrame, name: str, text_col: str = "text", id_col: str = "item_id",
              item_text_col: str = "text", width: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name``: words, hit word spans and item ids (as strings).

    The size of the items is measured first.  Up to ``block_bytes`` they are
    one broadcast set; beyond, items are dealt by a hash to as many blocks as
    keep each near that size, and the documents are scanned once per block,
    each pass written to the shared folder so that one set is held at a time.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(id_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("body"))
    size = chosen.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    plain = docs.columns
    out = docs
    for k in range(blocks):
        own = chosen if blocks == 1 else chosen.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in own.collect()], width))
        found = scan_windows(F.col(text_col), held)
        if k == 0:
            out = out.select(*[out[c] for c in plain], found.alias(name))
        else:
            new = free_name(out, name + "_block")
            out = out.withColumn(new, found).withColumn(name, F.struct(
                F.col(f"{name}.n_words"), F.concat(f"{name}.spans", f"{new}.spans").alias("spans"),
                F.array_distinct(F.concat(f"{name}.items", f"{new}.items")).alias("items"))).drop(new)
        if blocks > 1:
            out = stored(out)
            held.unpersist()
    return out


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a text."""
    inside = np.frombuffer(data.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the hit words (from the first byte of a span's first word to the end of its last)."""
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, f in zip(texts.to_pylist(), found.to_pylist()):
            if t is not None and f:
                data = t.encode()
                starts, ends = word_bounds(data)
                kept, at = [], 0
                for a, z in merged([(s["start"], s["stop"]) for s in f]):
                    kept.append(data[at:starts[a]])
                    at = ends[z - 1]
                t = (b"".join(kept) + data[at:]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text, spans)


def hit_words(spans: Column) -> Column:
    """Number of words in the union of the spans (they may overlap after several passes)."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], x["stop"]).alias("upto"))
    return F.aggregate(ordered, start, step, lambda s: s["n"])


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)`` of every document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_hits(d, items, "hits", **options).select(
        "doc_id", "hits.n_words", hit_words(F.col("hits.spans")).alias("n_hit"), "hits.spans", "hits.items")


@small_batches
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort("items"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


@small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark words; those of which no word is left go."""
    h = free_name(docs, "benchmark_hits")
    marked = with_hits(docs, table(spark, sf_dir, "benchmark"), h)
    n = hit_words(F.col(f"{h}.spans"))
    clean = marked.filter((n == 0) | (n < F.col(f"{h}.n_words")))
    text = cut_spans(F.col("text"), F.col(f"{h}.spans"))
    return _with_text(clean, docs, text)


def _with_text(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with a new text (and its length, where ``n_chars`` is kept)."""
    new = free_name(df, "new_text")
    changed = df.withColumn(new, text)
    return changed.select(*[
        changed[new].alias(c) if c == "text"
        else F.when(changed[new].isNull() | changed["text"].eqNullSafe(changed[new]), changed[c])
        .otherwise(F.char_length(changed[new])).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else changed[c] for c in docs.columns])


# ---- DuckDB SQL of the query -------------------------------------------------------

FOLD_SQL = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
           "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({FOLD_SQL.format("text")}, []) AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {FOLD_SQL.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, p, p + least(len(w), 10) - 1) AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, list_slice(w, p, p + n - 1) AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
