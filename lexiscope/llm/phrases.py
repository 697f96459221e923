"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

Words are runs of bytes other than space and tab inside pieces, which end at
``.,;:!?`` and line breaks; n-grams of one to four words never cross pieces and
are counted per language.

1. Each shard of texts (a written table) sums its n-grams by hash and sends,
   per hash partition, a sorted list of hashes and counts: the summary of a
   single shard, exact, as its mass is below any partition's capacity.
2. A partition merges its lists, a bounded batch at a time, into one
   Misra-Gries summary: when it holds more than ``capacity`` counters, the
   count next after the capacity's largest is taken off all of them.  The capacity
   exceeds mass / threshold, so all that is taken off one n-gram together is
   less than the threshold and every frequent n-gram keeps a counter.
3. Shards count the survivors exactly, by their words.  Survivors that are not
   frequent (taken off less than they seem, or sharing a hash) fall out here.
4. Candidates are scored at their weakest cut, and those that live inside a
   longer one are dropped, by joins on the exact counts.

Hashes are as long as the corpus needs (``hash_bits``); they only choose what is
counted in step 3, where n-grams of a shard are told apart by 128 bits.

Defined results: a null text is empty; a null language is ``und``; an empty
table gives no rows; ids, ties and repeated rows need no rule, as every row
counts; ranks are unique (phrases of a language are); other columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lexiscope.llm.common import SLICE_BYTES, release_memory, slices, small_batches, stored, table
from lexiscope.llm.simhash import LOWER
from lexiscope.llm.suffix_dedup import SHARD_BYTES, deflate, inflate, shard_table, unsqueeze
from lexiscope.llm.words import chained, mix, word_hashes

MAX_WORDS = 4
MIN_COUNT = 30
CONTAINED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
#: n-grams of a hash partition, and entries that a merge takes at once
PARTITION_MASS = 3_000_000
MERGE_ENTRIES = 500_000
#: occurrences that are looked up at once
LOOKUP = 500_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[*b" \t"]] = 1
_KIND[[*b".,;:!?\n\v\f\r"]] = 2


def hash_bits(total_bytes: int) -> int:
    """Enough for n-grams of ``total_bytes`` of text to share a hash rarely."""
    return min(64, max(32, ceil(log2(total_bytes + 1)) + 8))


class Grams:
    """The n-grams of a shard: hash and place of every occurrence."""

    def __init__(self, sizes: np.ndarray, data: bytes, langs: list[str | None], max_words: int = MAX_WORDS):
        self.langs = ["und" if x is None else x for x in langs]
        salt = np.array([xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)
        self.lower = data.translate(LOWER)
        ends = np.cumsum(sizes)
        parts, pieces = [], 0
        for a, z in slices(sizes.tolist(), SLICE_BYTES // 2):
            base = int(ends[a] - sizes[a])
            raw = np.frombuffer(self.lower, np.uint8)[base:int(ends[z - 1])]
            kind = _KIND[raw]
            first = np.zeros(len(raw), bool)  # a document is the start of a piece
            first[(ends[a:z] - sizes[a:z] - base)[sizes[a:z] > 0]] = True
            inside = kind == 0
            start = np.flatnonzero(inside & (first | ~np.concatenate([[False], inside[:-1]])))
            stop = np.flatnonzero(inside & ~np.concatenate([(inside & ~first)[1:], [False]])) + 1
            piece = np.cumsum((kind == 2) | first)
            parts.append((word_hashes(raw, start, stop), start + base, stop + base, piece[start] + pieces))
            pieces += int(piece[-1]) + 1 if len(piece) else 0
        if not parts:
            parts = [tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))]
        self.word, self.start, self.stop, piece = (np.concatenate(x) for x in zip(*parts))
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.salt = salt[self.doc] if len(salt) else np.zeros(0, np.uint64)
        self.at = []
        for n in range(1, max_words + 1):
            last = max(0, len(piece) - n + 1)
            at = np.flatnonzero(piece[:last] == piece[n - 1:n - 1 + last])
            self.at.append(at.astype(np.int32))

    def hashes(self, salt: int) -> np.ndarray:
        """64-bit hashes of all occurrences, words first, then pairs and so on."""
        word = self.word if not salt else mix(self.word ^ np.uint64(salt))
        return np.concatenate([mix(chained(word, n)[at] ^ (self.salt[at] + np.uint64(n)))
                               for n, at in enumerate(self.at, 1)])

    def place(self, occurrence: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first byte, end, words) of some occurrences."""
        ends = np.cumsum([len(a) for a in self.at])
        size = np.searchsorted(ends, occurrence, side="right") + 1
        at = np.empty(len(occurrence), np.int64)
        for n, own in enumerate(self.at, 1):
            mine = size == n
            at[mine] = own[occurrence[mine] - (ends[n - 1] - len(own))]
        return self.doc[at], self.start[at], self.stop[at + size - 1], size

    def summary(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of ``bits`` bits and their counts."""
        h = self.hashes(0)
        h >>= np.uint64(64 - bits)
        h.sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.flatnonzero(new)
        return h[lead], np.diff(np.concatenate([lead, [len(h)]])).astype(np.uint64)


def misra_gries(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Summaries merged into one of at most ``capacity`` counters, and what that took off each counter."""
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    if len(h):
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[lead], np.add.reduceat(c, lead)
    if len(h) <= capacity:
        return h, c, 0
    cut = np.partition(c, len(c) - capacity - 1)[len(c) - capacity - 1]
    keep = c > cut
    return h[keep], c[keep] - cut, int(cut)


def frequent(blobs: list[bytes], min_count: int, merge_entries: int = MERGE_ENTRIES) -> np.ndarray:
    """Sorted hashes that hold every n-gram of ``min_count`` occurrences in the lists of a partition."""
    mass = sum(int(inflate(b, 2)[1].sum()) for b in blobs)
    capacity = mass // min_count + 1
    kept, off = (np.zeros(0, np.uint64), np.zeros(0, np.uint64)), 0
    waiting, held = [], 0
    for n, blob in enumerate(blobs, 1):
        steps, counts = inflate(blob, 2)
        waiting.append((np.cumsum(steps, dtype=np.uint64), counts))
        held += len(steps)
        if held >= merge_entries or n == len(blobs):
            *kept, cut = misra_gries([kept, *waiting], capacity)
            off += cut
            waiting, held = [], 0
    return kept[0][kept[1].astype(np.int64) + off >= min_count]


def _grams(batch: pa.RecordBatch, max_words: int):
    for k in range(batch.num_rows):
        sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
        langs = batch.column("rest").slice(k, 1).flatten().field("lang").to_pylist()
        yield k, Grams(sizes, unsqueeze(batch.column("data")[k].as_py(), sizes.sum()), langs, max_words)


def survivors(shards: DataFrame, partitions: int, bits: int, min_count: int, max_words: int) -> DataFrame:
    """``(shard_id, part, keep)``: which of a shard's hashes the partitions' summaries kept, as bits."""
    edges = np.array([(k << bits) // partitions for k in range(1, partitions)], np.uint64)

    def give(batches):
        for batch in batches:
            for k, grams in _grams(batch, max_words):
                h, c = grams.summary(bits)
                cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
                out = [(p, deflate(np.diff(h[a:z], prepend=np.uint64(0)), c[a:z]))
                       for p, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if z > a]
                if out:
                    shard = batch.column("shard_id")[k].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _ in out], pa.int64()), pa.array([shard] * len(out), pa.int64()),
                         pa.array([x for _, x in out], pa.binary())], names=["part", "shard_id", "list"])
        release_memory()

    def merge(lists: pa.Table) -> pa.Table:
        blobs = lists["list"].to_pylist()
        found = np.append(frequent(blobs, min_count), _NONE)
        keep = []
        for blob in blobs:
            h = np.cumsum(inflate(blob, 2)[0], dtype=np.uint64)
            keep.append(np.packbits(found[np.searchsorted(found[:-1], h)] == h).tobytes())
        release_memory()
        return pa.table({"shard_id": lists["shard_id"], "part": lists["part"], "keep": pa.array(keep, pa.binary())})

    lists = shards.select("shard_id", "sizes", "rest", "data").mapInArrow(give, "part long, shard_id long, list binary")
    return lists.groupBy("part").applyInArrow(merge, "shard_id long, part long, keep binary")


def counted(shards: DataFrame, kept: DataFrame, partitions: int, bits: int, max_words: int) -> DataFrame:
    """``(lang, phrase, words, n)`` per shard for the survivors; ``phrase`` null with the number of all words."""
    edges = np.array([(k << bits) // partitions for k in range(1, partitions)], np.uint64)
    per_shard = kept.groupBy("shard_id").agg(F.collect_list(F.struct("part", "keep")).alias("kept"))

    def run(batches):
        for batch in batches:
            for k, grams in _grams(batch, max_words):
                distinct, _ = grams.summary(bits)
                cut = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
                keep = np.zeros(len(distinct), bool)
                for m in batch.column("kept")[k].as_py():
                    a, z = cut[m["part"]], cut[m["part"] + 1]
                    keep[a:z] = np.unpackbits(np.frombuffer(m["keep"], np.uint8), count=z - a)
                distinct = np.append(distinct[keep], _NONE)
                h = grams.hashes(0)
                at = []
                for a in range(0, len(h), LOOKUP):
                    short = h[a:a + LOOKUP] >> np.uint64(64 - bits)
                    at.append(np.flatnonzero(distinct[np.searchsorted(distinct[:-1], short)] == short).astype(np.int32) + a)
                at = np.concatenate([*at, np.zeros(0, np.int32)]).astype(np.int32)
                one = h[at]
                del h, keep
                two = grams.hashes(0x6A09E667F3BCC909)[at]
                by = np.lexsort((two, one))
                one, two, at = one[by], two[by], at[by]
                lead = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[:len(at)])
                n = np.diff(np.concatenate([lead, [len(at)]]))
                doc, start, stop, words = grams.place(at[lead])
                del one, two, by, at
                langs = np.array(grams.langs, object)
                text = grams.lower
                for i in range(0, len(lead), 50_000):
                    cut_ = slice(i, i + 50_000)
                    phrase = [b" ".join(text[a:z].split()).decode()
                              for a, z in zip(start[cut_].tolist(), stop[cut_].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(langs[doc[cut_]], pa.string()), pa.array(phrase, pa.string()),
                         pa.array(words[cut_], pa.int32()), pa.array(n[cut_], pa.int64())],
                        names=["lang", "phrase", "words", "n"])
                per_lang: dict[str, int] = {}
                for d, c in zip(*np.unique(grams.doc, return_counts=True)):
                    per_lang[grams.langs[d]] = per_lang.get(grams.langs[d], 0) + int(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(per_lang), pa.string()), pa.nulls(len(per_lang), pa.string()),
                     pa.array([0] * len(per_lang), pa.int32()), pa.array(list(per_lang.values()), pa.int64())],
                    names=["lang", "phrase", "words", "n"])
                del grams
                release_memory()

    return (shards.select("shard_id", "sizes", "rest", "data").join(per_shard, "shard_id")
            .mapInArrow(run, "lang string, phrase string, words int, n long"))


def frequent_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                    max_words: int = MAX_WORDS, partition_mass: int = PARTITION_MASS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` of all n-grams of at least ``min_count`` occurrences, and ``(lang, n)`` of all words."""
    docs = docs.select(F.lit(0).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    partitions = max(parallel, ceil(total * max_words / 7 / partition_mass))
    bits = hash_bits(total * max_words)
    shards = shard_table(docs, "id", "text", max(parallel, ceil(total / (2 * SHARD_BYTES))))
    kept = survivors(shards, partitions, bits, min_count, max_words)
    found = counted(shards, kept, partitions, bits, max_words)
    counts = stored(found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
                    .filter(F.col("phrase").isNull() | (F.col("f") >= min_count)))
    return counts.filter("phrase is not null"), counts.filter("phrase is null").select("lang", F.col("f").alias("n"))


def collocations(counts: DataFrame, words: DataFrame, top: int = TOP, contained_percent: int = CONTAINED_PERCENT,
                 scale: int = SCALE) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best candidates of each language."""
    max_words = MAX_WORDS
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    # every shorter phrase inside a longer candidate, and the largest count of one that holds it
    longer = candidates.filter("words > 2")
    inner = F.array(*[F.when((F.col("words") >= k + s) & (F.col("words") > s), F.concat_ws(" ", F.slice("w", k + 1, s)))
                      for s in range(2, max_words) for k in range(max_words - s + 1)])
    held = (longer.select("lang", F.col("a").alias("held"), F.explode(F.array_compact(inner)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("held").alias("held")))
    big = lambda c: F.col(c).cast("decimal(30,0)")
    alone = (candidates.join(held, ["lang", "phrase"], "left")
             .filter(F.col("held").isNull() | (big("held") * 100 < big("a") * contained_percent)))
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = (alone.select("lang", "phrase", "a", "words", "w", cuts)
           .select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"),
                   F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("right")))
    part = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cut = cut.join(part, ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr(f"cast({scale} as decimal(12,0)) * cast(a as decimal(19,0)) div cast(l + r as decimal(20,0))")
    scored = (cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
              .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return (best.join(words, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


@small_batches
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_ngrams(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (SELECT lang, k AS words, ws[i:i + k - 1] AS gram
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, words, array_to_string(gram, ' ') AS phrase, count(*) AS f
      FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1),
inside AS (
  SELECT lang, array_to_string(ws[s:s + k - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT lang, ws, a, k, unnest(range(1, words - k + 2)) AS s
        FROM cand, (SELECT unnest([2, 3]) AS k) WHERE k < words) GROUP BY ALL),
alone AS (SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase)
          WHERE held IS NULL OR 100::HUGEINT * held < 80::HUGEINT * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:words], ' ') AS rp
         FROM (SELECT *, unnest(range(1, words)) AS k FROM alone)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
                  ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
           QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN total USING (lang) QUALIFY rank <= 2000
"""
