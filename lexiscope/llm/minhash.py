"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct word shingles.  SuperMinHash gives every
shingle a random permutation of the signature's places; step by step it offers
the step number and a random fraction to its next place, each place keeping
its least offer.  As a shingle uses all places before it repeats one, places
are negatively correlated and the estimate varies less than with independent
hashes.  A set is done as soon as all its places hold offers of earlier steps
(early stopping), for most sets after one or two steps.

1. Texts are packed into shards (a written table).  Each row gives its set's
   size, a digest of 128 bits, band hashes and a sketch of one byte per place.
   Rows with the same digest are one class from here.
2. Bands meet by a groupBy with partial counts; bands with the same members
   are kept once.  Only classes that share a band go on; their sets are read
   back from the shards once.
3. In pieces of bounded size the sketches of a band's classes are compared and the
   pairs of a spanning forest of the likeliest ones are verified, so a group of
   near copies becomes one component by a number of verifications linear in its size.
4. Classes that share a band but are not yet connected are compared by their
   sketches, piece by piece; those with a pair that may reach the threshold meet again
   with their full sets, and every such pair is verified unless its components are
   joined already.  A task passes on a forest of the links it finds.  Bands with very many members are met on two shared bands
   instead of one (pairs at the threshold share more than one with the
   probability that ``tuned_bands`` asks for).
5. All verified links join into components.

Verification compares 64-bit shingle hashes of the whole sets.  Links are found
with probability ``RECALL`` at the threshold and nearly surely above; sets too
small to differ and still link (fewer than 4 at 0.8) meet by digest alone.

Defined results: a null text, or one without words, has an empty set, linked
with nothing (its component is its own id); fewer words than a shingle are one
shingle; a null id counts as larger than all others, so a component of only null
ids is null and all its rows are kept; rows that repeat an id are judged one
by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import SLICE_BYTES, discard, few_tasks, release_memory, slices, small_batches, stored, table
from lexiscope.llm.simhash import LOWER, Forest, components
from lexiscope.llm.suffix_dedup import SHARD_BYTES, shard_table, unsqueeze
from lexiscope.llm.words import chained, mix, word_hashes

SHINGLE_WORDS = 4
PERCENT = 80
PLACES = 128
RECALL = 1 - 1e-5
#: classes of a band that are compared at once
PIECE = 256
#: members of a band beyond which pairs must share two bands
HOT_BAND = 4096
#: rows of one task: documents, members of a band (a number or a sketch each), sets that are compared
ROWS_PER_TASK = 50_000
MEMBERS_PER_TASK = 10_000
SETS_PER_TASK = 5_000
_BLANK = np.isin(np.arange(256), [*b" \t\n\r\v\f"])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


# ---- signatures --------------------------------------------------------------------

def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, places: int) -> np.ndarray:
    """``(sets, places)``: the least offer (step, then a random fraction) that each place got from its set's elements."""
    least = np.full(sets * places, _NONE, np.uint64)
    table_ = least.reshape(sets, places)
    order = None  # each element's permutation, from the second step on
    for step in range(places):
        z = mix(elements ^ mix(np.array([step + 1], np.uint64)))
        at = step + (((z >> np.uint64(32)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
        if order is not None:
            rows = np.arange(len(at))
            place = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, step]
        else:
            place = at
        np.minimum.at(least, owner * places + place, (np.uint64(step) << np.uint64(32)) | (z & _LOW))
        open_sets = (table_ >= (np.uint64(step + 1) << np.uint64(32))).any(axis=1)
        going = open_sets[owner]
        if not going.any():
            break
        elements, owner = elements[going], owner[going]
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint16), (len(owner), 1))
            order[np.arange(len(owner)), place[going]] = 0
        else:
            order = order[going]
    return table_


def tuned_bands(similarity: float = PERCENT / 100, recall: float = RECALL, places: int = PLACES) -> tuple[int, int]:
    """(bands, rows): the most rows with which ``places`` places find a pair at the threshold in two bands or more."""
    shape = (places, 1)
    for rows in range(2, places):
        bands, p = places // rows, similarity ** rows
        if (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1) > 1 - recall:
            break
        shape = (bands, rows)
    return shape


def least_matches(similarity: float = PERCENT / 100, recall: float = RECALL, places: int = PLACES) -> int:
    """Equal places that a pair at the threshold has with the wanted probability (SuperMinHash varies less than this)."""
    missed, t = 0.0, 0
    while True:
        missed += comb(places, t) * similarity ** t * (1 - similarity) ** (places - t)
        if missed > 1 - recall:
            return t
        t += 1


class Sets:
    """The distinct shingles of a slice of texts, sorted within each text."""

    def __init__(self, texts: list[bytes], width: int = SHINGLE_WORDS):
        joined = b"\n".join(texts).translate(LOWER) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        inside = ~_BLANK[data]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        hashes = word_hashes(data, starts, ends)
        first = np.searchsorted(starts, base)
        n_words = np.diff(first)
        count = np.where(n_words >= width, n_words - width + 1, 0)
        doc = np.repeat(np.arange(len(texts)), count)
        at = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        shingle = chained(hashes, width)[at]
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        whole = [chained(hashes[first[d]:first[d + 1]], int(n_words[d]))[0] ^ np.uint64(n_words[d]) for d in short.tolist()]
        shingle = np.concatenate([shingle, np.array(whole, np.uint64)])
        doc = np.concatenate([doc, short])
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
        self.shingle, self.doc = shingle[new], doc[new]
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.lead = np.cumsum(self.count) - self.count

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two sums of mixed shingles per text (0 for an empty set)."""
        out = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.shingle ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(mix(total[self.lead + self.count] - total[self.lead]))
        return out[0], out[1]


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h ^ mix(signature[:, b * rows + r]))
        out[:, b] = h
    return out


# ---- Spark -----------------------------------------------------------------------------

def _shard_slices(batch: pa.RecordBatch, k: int, only: np.ndarray | None = None):
    """Documents of row ``k`` of a shard batch, in slices: (numbers, texts)."""
    sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
    data = unsqueeze(batch.column("data")[k].as_py(), sizes.sum())
    ends = np.cumsum(sizes)
    chosen = np.arange(len(sizes)) if only is None else only
    for a, z in slices(sizes[chosen].tolist(), SLICE_BYTES // 2):
        yield chosen[a:z], [data[ends[d] - sizes[d]:ends[d]] for d in chosen[a:z].tolist()]


PRINT = "shard_id long, doc int, id long, n long, set1 long, set2 long, bands array<long>, sketch binary"


def sketches(shards: DataFrame, percent: int, places: int, bands: int, rows: int, width: int) -> DataFrame:
    """One row per document: place in the shards, id, set size and digests, bands and sketch (null for small sets)."""
    # a partner with other shingles at the threshold needs at least this many
    least = -(-percent // (100 - percent)) if percent < 100 else None

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, shard = batch.column("ids").slice(k, 1).flatten(), batch.column("shard_id")[k].as_py()
                for docs, texts in _shard_slices(batch, k):
                    s = Sets(texts, width)
                    one, two = s.digests()
                    big = s.count >= least if least else np.zeros(len(texts), bool)
                    number = np.cumsum(big) - 1
                    mine = big[s.doc]
                    signature = superminhash(s.shingle[mine], number[s.doc[mine]], int(big.sum()), places)
                    bits = (mix(signature) & np.uint64(255)).astype(np.uint8)
                    band = band_hashes(signature, bands, rows).view(np.int64)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(big, bands, 0))]), pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(docs), shard), pa.int64()), pa.array(docs, pa.int32()),
                        ids.take(pa.array(docs, pa.int64())), pa.array(s.count, pa.int64()),
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(band.ravel())),
                        pa.array([bits[number[i]].tobytes() if big[i] else None for i in range(len(docs))], pa.binary())],
                        names=[f.split(" ")[0] for f in PRINT.split(", ")])
        release_memory()

    return shards.select("shard_id", "ids", "sizes", "data").mapInArrow(run, PRINT)


def class_sets(shards: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of ``wanted(node, shard_id, doc)``: sorted 64-bit hashes, read from the shards."""
    per_shard = wanted.groupBy("shard_id").agg(F.collect_list(F.struct("doc", "node")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("wanted").slice(k, 1).flatten()
                doc, node = own.field("doc").to_numpy(), own.field("node").to_numpy()
                order = np.argsort(doc, kind="stable")
                doc, node = doc[order].astype(np.int64), node[order]
                at = 0
                for docs, texts in _shard_slices(batch, k, doc):
                    s = Sets(texts, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[at:at + len(docs)], pa.int64()),
                         pa.array([s.shingle[a:a + c].tobytes() for a, c in zip(s.lead.tolist(), s.count.tolist())],
                                  pa.binary())], names=["node", "shingles"])
                    at += len(docs)
        release_memory()

    return (shards.select("shard_id", "sizes", "data").join(per_shard, "shard_id")
            .mapInArrow(run, "node long, shingles binary"))


def _reaches(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Are two sorted sets at least ``percent`` similar (Jaccard)?"""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(small) + len(large) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, piece: int = 256) -> DataFrame:
    """The ``pairs(x, y)`` (a written table) whose sets reach the threshold.

    The set of ``x`` goes once to every piece of its partners, theirs follow in
    the same sorted stream: a task holds one set of each side.
    """
    cuts = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / piece).alias("cuts"))
    dealt = (pairs.join(cuts, "x")
             .select("x", F.pmod(F.xxhash64("y", F.lit(7)), F.col("cuts")).alias("piece"), "y"))
    heads = dealt.select("x", "piece").distinct().join(sets, F.col("x") == F.col("node"))
    rows = (dealt.join(sets, F.col("y") == F.col("node")).select("x", "piece", "y", "shingles")
            .unionByName(heads.select("x", "piece", F.lit(None).cast("long").alias("y"), "shingles")))
    rows = rows.repartition("x", "piece").sortWithinPartitions("x", "piece", F.col("y").asc_nulls_first())

    def run(batches):
        head = np.zeros(0, np.uint64)
        for batch in batches:
            xs, ys, blobs = batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("shingles")
            out = []
            for i, (x, y) in enumerate(zip(xs, ys)):
                own = np.frombuffer(blobs[i].as_py(), np.uint64)
                if y is None:
                    head = own
                    continue
                if _reaches(own, head, percent):
                    out.append((x, y))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release_memory()

    # a task reads sorted partitions one after the other, each with the whole of its pieces
    return few_tasks(rows.select("x", "y", "shingles"), pairs.count(), SETS_PER_TASK).mapInArrow(run, "a long, b long")


def _members(batch: pa.RecordBatch, k: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, components, sketches) of a piece."""
    own = batch.column(name).slice(k, 1).flatten()
    sketch = np.frombuffer(b"".join(own.field("sketch").to_pylist()), np.uint8).reshape(len(own), -1)
    return own.field("node").to_numpy(), own.field("comp").to_numpy(), sketch


def _matches(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal places of every pair of sketches."""
    out = np.empty((len(one), len(two)), np.int32)
    for i in range(0, len(one), 64):
        out[i:i + 64] = (one[i:i + 64, None, :] == two[None, :, :]).sum(axis=2, dtype=np.int32)
    return out


def spanning(matches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a forest of the largest ``matches`` (at least ``least``) that spans all that are connected."""
    n = len(matches)
    best, link = np.full(n, -1), np.zeros(n, np.int64)
    out, waiting = [], np.ones(n, bool)
    for _ in range(n):
        at = int(np.where(waiting, best, -2).argmax())
        if best[at] >= least:
            out.append((int(link[at]), at))
        waiting[at] = False
        closer = waiting & (matches[at] > best)
        best[closer], link[closer] = matches[at][closer], at
    return out


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())],
                                      names=["x", "y"])


def _forest_pairs(met: DataFrame, prints: DataFrame, matches: int, piece: int) -> DataFrame:
    """``(x, y)``: likely links that span the members of each piece of a band of ``met(band, node, n)``."""
    cut = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / piece))
    pieces = (met.join(prints, "node").withColumn("cut", cut).groupBy("band", "cut")
              .agg(F.collect_list(F.struct("node", F.col("node").alias("comp"), "sketch")).alias("rows")))

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                node, _, sketch = _members(batch, k, "rows")
                out += [(node[i], node[j]) for i, j in spanning(_matches(sketch, sketch), matches)]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield _pairs_batch(a, b)
        release_memory()

    pieces = few_tasks(pieces.select("rows"), met.count(), MEMBERS_PER_TASK)
    return few_tasks(pieces.mapInArrow(run, "x long, y long").distinct(), met.count(), MEMBERS_PER_TASK)


def _met_pieces(members: DataFrame, cut: Column, columns: list[str], rows: int, per_task: int) -> DataFrame:
    """Pairs of pieces ``(band, rows, rows2)`` of ``members``; pieces of one and the same component do not meet."""
    pieces = (members.withColumn("cut", cut).groupBy("band", "cut")
              .agg(F.collect_list(F.struct(*columns)).alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    pieces = stored(few_tasks(pieces, rows, per_task))
    other = pieces.toDF("band", "cut2", "rows2", "lo2", "hi2")
    met = (pieces.join(other, "band").filter("cut <= cut2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
           .select("band", "rows", "rows2"))
    return few_tasks(met, rows, per_task)


def _open_members(members: DataFrame, prints: DataFrame, matches: int, piece: int) -> DataFrame:
    """Those of ``members(band, node, comp)`` whose sketch is like one of another component in the band."""
    per = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("nc"))
    per_band = per.groupBy("band").agg(F.sum("nc").alias("n"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    # a large component has pieces of its own, so that pairs of such pieces need not meet
    cut = F.when(F.col("nc") > piece, F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("nc") / piece))))
    cut = cut.otherwise(F.pmod(F.xxhash64("comp", F.lit(3)), F.ceil(F.col("n") / piece)))
    mixed = members.join(per.join(per_band, "band"), ["band", "comp"]).join(prints, "node")
    met = _met_pieces(mixed, cut, ["node", "comp", "sketch"], members.count(), MEMBERS_PER_TASK)

    def run(batches):
        for batch in batches:
            bands = batch.column("band").to_pylist()
            for k in range(batch.num_rows):
                (n1, c1, s1), (n2, c2, s2) = (_members(batch, k, name) for name in ("rows", "rows2"))
                like = (_matches(s1, s2) >= matches) & (c1[:, None] != c2[None, :])
                found = np.union1d(n1[like.any(axis=1)], n2[like.any(axis=0)])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bands[k])), pa.array(found)],
                                                     names=["band", "node"])
        release_memory()

    found = met.mapInArrow(run, "band long, node long").distinct()
    return found.join(members, ["band", "node"])


def _cross_links(members: DataFrame, sets: DataFrame, prints: DataFrame, matches: int, percent: int, piece: int) -> DataFrame:
    """``(a, b)``: verified links between the components of ``members(band, node, comp)``, a forest of them per task.

    A pair that shares several bands is verified in the least of them.
    """
    rows_ = members.count()
    open_ = stored(few_tasks(_open_members(members, prints, matches, piece), rows_, MEMBERS_PER_TASK))
    sizes = open_.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    shared = open_.groupBy("node").agg(F.collect_list("band").alias("bands"))
    rows = open_.join(sizes, "band").join(shared, "node").join(prints, "node").join(sets, "node")
    met = _met_pieces(rows, F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / piece)),
                      ["node", "comp", "sketch", "bands", "shingles"], open_.count(), SETS_PER_TASK)

    def run(batches):
        forest = Forest()
        for batch in batches:
            at = batch.column("band").to_pylist()
            for k in range(batch.num_rows):
                sides = []
                for name in ("rows", "rows2"):
                    own = batch.column(name).slice(k, 1).flatten()
                    sides.append((*_members(batch, k, name), [frozenset(b) for b in own.field("bands").to_pylist()],
                                  own.field("shingles")))
                (_, c1, s1, b1, t1), (_, c2, s2, b2, t2) = sides
                p, q = np.nonzero((_matches(s1, s2) >= matches) & (c1[:, None] != c2[None, :]))
                last, one = -1, None
                for i, j in zip(p.tolist(), q.tolist()):
                    x, y = int(c1[i]), int(c2[j])
                    if forest.find(x) == forest.find(y) or min(b1[i] & b2[j]) != at[k]:
                        continue
                    if i != last:
                        last, one = i, np.frombuffer(t1[i].as_py(), np.uint64)
                    if _reaches(one, np.frombuffer(t2[j].as_py(), np.uint64), percent):
                        forest.join(x, y)
        edges = np.array([(x, r) for x in forest.up if (r := forest.find(x)) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
        release_memory()

    return met.mapInArrow(run, "a long, b long")


def near_links(shards: DataFrame, classes: DataFrame, percent: int = PERCENT, places: int = PLACES,
               width: int = SHINGLE_WORDS, piece: int = PIECE, hot_band: int = HOT_BAND) -> DataFrame:
    """``(node, root)`` of every class that is linked with another one; ``shards`` is deleted once it has been read."""
    member = classes.filter("bands is not null").select("node", F.explode("bands").alias("band"))
    groups = (member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("p"),
                                         F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q")).filter("n > 1"))
    # near copies share most of their bands: bands with the same members (by a digest of 128 bits) are met once
    groups = groups.groupBy("n", "p", "q").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("weight"))
    met = stored(few_tasks(member.join(groups.select("band", "n", "weight"), "band"), classes.count(), ROWS_PER_TASK))
    wanted = met.select("node").distinct()
    sets = stored(class_sets(shards, classes.select("node", "shard_id", "doc").join(wanted, "node"), width))
    discard(shards)  # from here on only written tables are read
    prints, least = classes.select("node", "sketch"), least_matches(percent / 100, RECALL, places)
    links = stored(verified(stored(_forest_pairs(met, prints, least, piece)), sets, percent))
    n_links = links.count()
    roots = stored(few_tasks(components(links, rows=n_links), n_links, ROWS_PER_TASK))
    comps = (wanted.join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
             .select("node", F.coalesce("root", "node").alias("comp")))
    named = few_tasks(met.join(comps, "node"), met.count(), ROWS_PER_TASK)
    # a band that stands for several with the same members is met by itself: its pairs share two bands
    usual = named.filter((F.col("n") <= hot_band) | (F.col("weight") > 1)).select("band", "node", "comp")
    hot = named.filter(F.col("n") > hot_band).select("band", "node", "comp")
    other = met.filter(F.col("n") > hot_band).select("node", F.col("band").alias("band2"))
    twice = hot.join(other, "node").filter("band < band2").select(F.xxhash64("band", "band2").alias("band"), "node", "comp")
    # late links join components: these are the nodes of a small graph of their own
    members = stored(usual.unionByName(twice))  # counted, and read by every step that meets them
    joined = stored(_cross_links(members, sets, prints, least, percent, piece))
    late = components(joined, rows=joined.count()).toDF("comp", "late")
    nodes = roots.select("node", F.col("root").alias("comp")).unionByName(
        late.select(F.col("comp").alias("node"), "comp").join(roots.select("node"), "node", "left_anti"))
    return nodes.join(late, "comp", "left").select("node", F.coalesce("late", "comp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    width: int = SHINGLE_WORDS, places: int = PLACES, piece: int = PIECE,
                    hot_band: int = HOT_BAND) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    bands, rows = tuned_bands(percent / 100, RECALL, places)
    shards = shard_table(docs, "doc_id", "text", max(parallel, ceil(total / (2 * SHARD_BYTES))))
    prints = stored(sketches(shards, percent, places, bands, rows, width))
    # the first row of a class stands for it; its bands and sketch travel once per class and task
    classes = (prints.filter("n > 0").groupBy("set1", "set2")
               .agg(F.min("id").alias("least"), F.min(F.struct("shard_id", "doc", "bands", "sketch")).alias("first"))
               .select("set1", "set2", "least", "first.*"))
    documents = prints.count()
    classes = stored(few_tasks(classes, documents, ROWS_PER_TASK)
                     .withColumn("bands", F.when(F.size("bands") > 0, F.col("bands")))
                     .withColumn("node", F.monotonically_increasing_id()))
    roots = near_links(shards, classes, percent, places, width, piece, hot_band).withColumnRenamed("node", "own")
    named = (classes.select("set1", "set2", "least", "node").join(roots, F.col("node") == F.col("own"), "left")
             .withColumn("root", F.coalesce("root", "node")))
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    named = named.select("set1", "set2", "root").join(heads, "root").select("set1", "set2", "head")
    named = stored(few_tasks(named, documents, ROWS_PER_TASK))
    full = prints.select("id", "n", "set1", "set2").filter("n > 0").join(named, ["set1", "set2"])
    empty = prints.filter("n = 0").select("id", "n", F.col("id").alias("head"))
    return (full.select("id", "n", "head").unionByName(empty)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("head").alias("component_id"),
                    F.col("id").eqNullSafe(F.col("head")).alias("kept")))


@small_batches
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
