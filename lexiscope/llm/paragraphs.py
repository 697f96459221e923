"""Near-duplicate paragraphs by MinHash banding.

A paragraph has at least ``LEAST_WORDS`` words and is one of

* a line;
* a run: the text from an anchor word to the next anchor at least that many
  words on, across line breaks.  A word is an anchor if the hash of it and its
  successor is the least within ``REACH`` words on both sides, so the same passage
  has the same runs in whatever text it stands.

A character of three or more UTF-8 bytes is a word by itself, so scripts without
spaces have paragraphs too.  Shingles are five words.  Lines link by exact Jaccard
similarity; runs overlap one another and link where all their shingles are equal (in
so short a text one other word already falls below 0.8).  Bands are tuned for
recall: ``tuned_bands`` takes the shape with the fewest hashes that finds a pair at
the threshold with the wanted probability.

1. Shards (a written table) give the sorted hashes of their lines' bands and
   of all paragraphs' shingles; the lists meet by hash range and each shard
   learns which of its hashes also occur elsewhere.
2. Only colliding paragraphs go on.  Those with the same shingles (by a digest of
   128 bits) are one class from here; classes that share a band are compared by
   exact Jaccard, in pieces of bounded size; a task passes on a forest of the links
   it finds.
3. Classes join into components; the first paragraph of each (smallest doc_id,
   then place) stays, the others are cut out.

Defined results: null and empty texts have no paragraphs; shorter lines never
link by themselves; a null doc_id counts as larger than all others; repeated rows
are ordered by their place in the shard table; an empty table gives no rows; other
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lexiscope.llm.common import release_memory, slices, small_batches, stored, table
from lexiscope.llm.simhash import Forest, components
from lexiscope.llm.suffix_dedup import (
    LAST, SHARD_BYTES, apply_runs, bucket_bounds, deflate, inflate, removed_bytes, shard_table, unsqueeze,
)
from lexiscope.llm.words import chained, mix, word_hashes

SHINGLE_WORDS = 5
LEAST_WORDS = 24
REACH = 3
MIN_JACCARD = 0.8
RECALL = 0.999
BUCKET_HASHES = 500_000
SLICE_BYTES = 1 << 20
PIECE = 256
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c == 10 else 32
             for c in range(256))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def tuned_bands(similarity: float = MIN_JACCARD, recall: float = RECALL, least_rows: int = 2) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with at least ``least_rows`` rows that reach the recall."""
    shapes = []
    for rows in range(least_rows, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))
        shapes.append((bands * rows, bands, rows))
    return min(shapes)[1:]


def word_places(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in folded bytes."""
    inside = folded > 32
    wide3, wide4, tail = (folded >= 0xE0) & (folded < 0xF0), folded >= 0xF0, (folded & 0xC0) == 0x80
    cut = wide3 | wide4
    cut[3:] |= wide3[:-3] & ~tail[3:]
    cut[4:] |= wide4[:-4] & ~tail[4:]
    start = inside & (cut | ~np.concatenate([[False], inside[:-1]]))
    stop = inside & np.concatenate([start[1:] | ~inside[1:], [True]])
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def anchors(pair: np.ndarray, doc: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Words whose hash is the least (the first of equals) within ``reach`` words of their document."""
    if not len(pair):
        return np.zeros(0, np.int64)
    at = np.arange(len(pair)) + (doc + 1) * reach  # a gap between documents
    spread = np.full(int(at[-1]) + reach + 1, _NONE)
    spread[at] = pair
    best = spread[reach:-reach].copy() if reach else spread.copy()
    keep = np.ones(len(best), bool)
    for d in range(1, reach + 1):
        keep &= (best < spread[reach - d:len(spread) - reach - d]) & (best <= spread[reach + d:len(spread) - reach + d])
    return np.flatnonzero(keep[at - reach])


class Paragraphs:
    """The paragraphs of a shard: place, shingle digests, and the lines' band hashes.

    ``line`` has the lines' index in ``band``, -1 for runs; paragraph ``i`` has the
    shingles ``shingle[lead[i]:lead[i] + count[i]]`` (in text order, repeats included).
    """

    def __init__(self, sizes: np.ndarray, data: bytes, bands: int, rows: int, min_jaccard: float, least_words: int):
        ends = np.cumsum(sizes)
        parts, shingles, lines = [], 0, 0
        for a, z in slices(sizes.tolist(), SLICE_BYTES):
            shingle, lead, doc, line, band, *rest = self._part(
                sizes[a:z], data[ends[a] - sizes[a]:ends[z - 1]], bands, rows, least_words)
            parts.append((shingle, lead + shingles, doc + a, np.where(line < 0, -1, line + lines), band, *rest))
            shingles += len(shingle)
            lines += len(band)
        (self.shingle, self.lead, self.doc, self.line, self.band, self.count, self.start, self.stop, self.set1,
         self.set2) = (np.concatenate(x) for x in zip(*parts))
        # a partner with other shingles at the threshold needs at least this many
        least = np.ceil(min_jaccard / (1 - min_jaccard) - 1e-9) if min_jaccard < 1 else np.inf
        own = np.flatnonzero(self.line >= 0)
        self.banded = np.zeros(len(self.band), bool)
        self.banded[self.line[own]] = self.count[own] >= least

    @staticmethod
    def _part(sizes: np.ndarray, data: bytes, bands: int, rows: int, least: int) -> tuple[np.ndarray, ...]:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = b"\n".join(data[a:z] for a, z in zip(starts.tolist(), ends.tolist()))  # no line crosses texts
        folded = np.frombuffer(joined.translate(FOLD), np.uint8)
        base = starts + np.arange(len(sizes))
        breaks = np.flatnonzero(folded == 10)
        line_start = np.concatenate([[0], breaks + 1])
        line_stop = np.concatenate([breaks, [len(joined)]])
        word_start, word_stop = word_places(folded)
        hashes = word_hashes(folded, word_start, word_stop)
        n = len(hashes)
        word_doc = np.searchsorted(base, word_start, side="right") - 1
        last = SHINGLE_WORDS - 1
        shingle = np.concatenate([chained(hashes, SHINGLE_WORDS), np.zeros(min(last, n), np.uint64)])
        # lines: their words, and the break goes with its line
        edge = np.searchsorted(word_start, np.concatenate([line_start, [len(joined) + 1]]))
        own = np.flatnonzero(np.diff(edge) >= least)
        line_lead, line_words = edge[own], np.diff(edge)[own]
        line_doc = np.searchsorted(base, line_start[own], side="right") - 1
        # runs: from an anchor to the first one far enough on
        pair = np.concatenate([chained(hashes, 2), hashes[-1:]])
        if n:  # a document's last word has no successor
            pair[np.flatnonzero(word_doc[1:] != word_doc[:-1])] = _NONE
            pair[-1] = _NONE
        at = anchors(pair, word_doc)
        to = np.searchsorted(at, at + least)
        fits = np.flatnonzero(to < len(at))
        fits = fits[word_doc[at[fits]] == word_doc[at[to[fits]]]]
        run_lead, run_stop = at[fits], at[to[fits]]
        run_doc = word_doc[run_lead]
        lead, words = np.concatenate([line_lead, run_lead]), np.concatenate([line_words, run_stop - run_lead])
        doc = np.concatenate([line_doc, run_doc])
        start = np.concatenate([line_start[own], word_start[run_lead]]) - base[doc]
        stop = np.concatenate([line_stop[own] + 1, word_start[run_stop]]) - base[doc]
        stop = np.minimum(stop, sizes[doc])
        count = words - last
        digests = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingle ^ np.uint64(salt)), dtype=np.uint64)])
            digests.append(mix(total[lead + count] - total[lead]))
        band = np.zeros((len(own), bands), np.uint64)
        if len(own):
            edges = np.stack([line_lead, line_lead + line_words - last], axis=1).ravel()
            for b in range(bands):
                h = np.full(len(own), b + 1, np.uint64)
                for r in range(rows):
                    salt = np.uint64(xxh3_64_intdigest(b"%d" % (b * rows + r)))
                    h = mix(h ^ np.minimum.reduceat(mix(shingle ^ salt), edges)[::2])
                band[:, b] = h
        line = np.concatenate([np.arange(len(own)), np.full(len(run_lead), -1)])
        return shingle, lead, doc, line, band, count, start, stop, *digests

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes (bands and digests) and how often each occurs here."""
        return np.unique(np.concatenate([self.band[self.banded].ravel(), self.set1]), return_counts=True)


def _each(batch: pa.RecordBatch, *options):
    for k in range(batch.num_rows):
        sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
        yield k, Paragraphs(sizes, unsqueeze(batch.column("data")[k].as_py(), sizes.sum()), *options)


def colliding(shards: DataFrame, buckets: int, bands: int, rows: int, min_jaccard: float, least_words: int) -> DataFrame:
    """``(shard_id, doc, id, start, stop, set1, set2, shingles, bands)`` of paragraphs that share a hash.

    The distinct shingles and the bands are given for lines, once per digest and shard.
    """
    options = bands, rows, min_jaccard, least_words

    def give(batches):
        for batch in batches:
            for k, p in _each(batch, *options):
                found, _ = p.hashes()
                cut = bucket_bounds(found, buckets)
                out = [(b, deflate(found[a:z])) for b, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in out], pa.int64()),
                         pa.array([batch.column("shard_id")[k].as_py()] * len(out), pa.int64()),
                         pa.array([x for _, x in out], pa.binary())], names=["bucket", "shard_id", "list"])
        release_memory()

    def merge(lists: pa.Table) -> pa.Table:
        each = [inflate(b, 1)[0] for b in lists["list"].to_pylist()]
        merged = np.sort(np.concatenate(each))
        again = [np.packbits(np.searchsorted(merged, x, "right") - np.searchsorted(merged, x, "left") > 1).tobytes()
                 for x in each]
        return pa.table({"shard_id": lists["shard_id"], "bucket": lists["bucket"], "again": pa.array(again, pa.binary())})

    lists = shards.select("shard_id", "sizes", "data").mapInArrow(give, "bucket long, shard_id long, list binary")
    marks = lists.groupBy("bucket").applyInArrow(merge, "shard_id long, bucket long, again binary")
    per_shard = marks.groupBy("shard_id").agg(F.collect_list(F.struct("bucket", "again")).alias("marks"))
    schema = ("shard_id long, doc int, id long, start long, stop long, set1 long, set2 long, shingles array<long>, "
              "bands array<long>")

    def hits(batches):
        for batch in batches:
            for k, p in _each(batch, *options):
                found, counts = p.hashes()
                cut = bucket_bounds(found, buckets)
                again = counts > 1
                for m in batch.column("marks")[k].as_py():
                    a, z = cut[m["bucket"]], cut[m["bucket"] + 1]
                    again[a:z] |= np.unpackbits(np.frombuffer(m["again"], np.uint8), count=z - a).astype(bool)
                again = np.append(again, False)  # hashes of bands that are not given are past the end, or miss
                band_hit = again[np.searchsorted(found, p.band)] & p.banded[:, None]
                is_hit = again[np.searchsorted(found, p.set1)]
                lines = np.flatnonzero(p.line >= 0)
                is_hit[lines] |= band_hit[p.line[lines]].any(axis=1)
                hit = np.flatnonzero(is_hit)
                ids = np.array([LAST if i is None else i for i in batch.column("ids")[k].as_py()], np.int64)
                shard = batch.column("shard_id")[k].as_py()
                first = np.zeros(len(p.line), bool)
                own = hit[p.line[hit] >= 0]
                if len(own):
                    by = own[np.lexsort((p.set2[own], p.set1[own]))]
                    first[by[np.concatenate([[True], (p.set1[by[1:]] != p.set1[by[:-1]]) |
                                             (p.set2[by[1:]] != p.set2[by[:-1]])])]] = True
                for i in range(0, len(hit), 20_000):
                    part = hit[i:i + 20_000]
                    shingles, bands_ = [None] * len(part), [None] * len(part)
                    for j in np.flatnonzero(first[part]).tolist():
                        w = part[j]
                        shingles[j] = np.unique(p.shingle[p.lead[w]:p.lead[w] + p.count[w]]).view(np.int64)
                        bands_[j] = p.band[p.line[w]][band_hit[p.line[w]]].view(np.int64)
                    d = p.doc[part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), shard), pa.int64()), pa.array(d, pa.int32()), pa.array(ids[d]),
                         pa.array(p.start[part], pa.int64()), pa.array(p.stop[part], pa.int64()),
                         pa.array(p.set1[part].view(np.int64)), pa.array(p.set2[part].view(np.int64)),
                         pa.array(shingles, pa.list_(pa.int64())), pa.array(bands_, pa.list_(pa.int64()))],
                        names=[f.split(" ")[0] for f in schema.split(", ")])
        release_memory()

    return shards.select("shard_id", "ids", "sizes", "data").join(per_shard, "shard_id").mapInArrow(hits, schema)


def jaccard_links(classes: DataFrame, min_jaccard: float = MIN_JACCARD, piece: int = PIECE) -> DataFrame:
    """``(a, b)``: forest edges over ``classes(node, shingles, bands)`` that share a band and reach the threshold."""
    # most bands are alone once copies are one class: shingles follow only where two classes meet
    member = classes.select("node", F.explode("bands").alias("band"))
    sizes = (member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1"))
    # near copies share most of their bands: bands with the same members (by a digest of 128 bits) are compared once
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
    met = stored(member.join(sizes, "band"))
    pieces = stored(met.join(classes.select("node", "shingles"), "node")
                    .groupBy("band", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / piece)).alias("piece"))
                    .agg(F.collect_list("node").alias("nodes"), F.collect_list("shingles").alias("sets")))
    other = pieces.toDF("band", "other", "other_nodes", "other_sets")
    pairs = pieces.join(other, "band").filter("piece <= other")

    def verify(batches):
        forest = Forest()
        for batch in batches:
            left, right = (list(zip(batch.column(n).to_pylist(), batch.column(s).to_pylist()))
                           for n, s in (("nodes", "sets"), ("other_nodes", "other_sets")))
            for (an, asets), (bn, bsets) in zip(left, right):
                bsets = [frozenset(s) for s in bsets]
                for x, s in zip(an, map(frozenset, asets)):
                    for y, t in zip(bn, bsets):
                        small, large = sorted((len(s), len(t)))
                        if x == y or small < min_jaccard * large or forest.find(x) == forest.find(y):
                            continue
                        shared = len(s & t)
                        if shared >= min_jaccard * (small + large - shared) - 1e-9:
                            forest.join(x, y)
        edges = [(x, forest.find(x)) for x in forest.up]
        edges = np.array([e for e in edges if e[0] != e[1]], np.int64).reshape(-1, 2)
        for i in range(0, len(edges), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(edges[i:i + 50_000, 0]), pa.array(edges[i:i + 50_000, 1])],
                                             names=["a", "b"])

    return pairs.select("nodes", "sets", "other_nodes", "other_sets").mapInArrow(verify, "a long, b long")


def remove_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_jaccard: float = MIN_JACCARD, recall: float = RECALL,
                      least_words: int = LEAST_WORDS) -> DataFrame:
    """``(rest, n_bytes, spans, kept, owners)``: documents without paragraphs that nearly repeat an earlier one.

    ``owners`` are the ids of the documents that keep the paragraphs cut here.
    """
    least_words = max(least_words, SHINGLE_WORDS)
    bands, rows = tuned_bands(min_jaccard, recall)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    shards = shard_table(docs, id_col, text_col, max(parallel, -(-total // (2 * SHARD_BYTES))))
    # about one line of (bands + 1) hashes and three runs of one in 200 bytes
    buckets = max(parallel, int(total / 200 * (bands + 4) / BUCKET_HASHES) + 1)
    found = stored(colliding(shards, buckets, bands, rows, min_jaccard, least_words))
    place = F.struct("id", "shard_id", "doc", "start")
    classes = stored(found.groupBy("set1", "set2")
                     .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
                          F.first("shingles", ignorenulls=True).alias("shingles"),
                          F.first("bands", ignorenulls=True).alias("bands"))
                     .withColumn("node", F.monotonically_increasing_id()))
    roots = components(jaccard_links(classes, min_jaccard))
    linked = (classes.select("set1", "set2", "first", "n", F.col("node").alias("own"))
              .join(roots, F.col("own") == F.col("node"), "left").withColumn("root", F.coalesce("root", "own")))
    heads = linked.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("members")).filter("members > 1")
    named = linked.join(heads, "root").select("set1", "set2", "head")
    runs = (found.drop("shingles", "bands").join(named, ["set1", "set2"]).filter(place != F.col("head"))
            .select("shard_id", "doc", "start", "stop", F.col("head.id").alias("owner")))
    return apply_runs(shards, runs)


@small_batches
def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("rest.doc_id", "n_bytes", removed_bytes(F.col("spans")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "owners")
