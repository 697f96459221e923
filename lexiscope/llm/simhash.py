"""SimHash near-duplicates by tiled exact comparison.

A fingerprint's 64 bits are cut into equal parts and a tile holds fingerprints
with the same population count in every part.  Two fingerprints within the
radius have population counts that differ by no more than the radius over all
parts together, so every other pair of tiles is skipped; the remaining pairs
are compared in full by exclusive-or and bit counts in numpy.

Copies (equal fingerprints) are one row from the start.  A task joins the
links it finds in a local forest and passes on the forest only, so a dense
group never gives all its pairs; connected components finish over the forests.

Defined results: a null or wordless text has fingerprint zero, linked like any
other; a null id counts as larger than all others (the component of documents
that have only null ids is null); rows that repeat an id are judged one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import few_tasks, free_name, ragged_arange, release_memory, slices, small_batches, stored, table, text_slices

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
PARTS = 4
TILE_ROWS = 2048


# ---- fingerprints -------------------------------------------------------------

def fingerprint(data: bytes, width: int = SHINGLE_WORDS) -> int:
    words = data.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    starts, ends = starts.tolist(), ends.tolist()
    for i in range(0, len(starts), 65_536):  # bounded however long the text
        raw = b"".join([digest(joined[a:z], SEED) for a, z in zip(starts[i:i + 65_536], ends[i:i + 65_536])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def simhash64(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a text as a (signed) long."""
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_slices(texts):
            out += [fingerprint(t, width) for t in part]
        release_memory()
        return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long").asNondeterministic()(text.cast("string"))


# ---- tiles ---------------------------------------------------------------------

def _part_counts(fp: Column, parts: int) -> list[Column]:
    size = 64 // parts
    mask = -1 if size == 64 else (1 << size) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, size * k).bitwiseAND(F.lit(mask).cast("long"))) for k in range(parts)]


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, one of each pair of opposites."""
    out = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    return [s for s in out if s >= tuple([0] * parts)]


class Forest:
    """Union-find over fingerprints; the smaller one is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> None:
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1 << 20):
    """Index pairs of two tiles within the radius, compared in blocks of bounded size."""
    rows = max(1, block // max(1, len(b)))
    for i in range(0, len(a), rows):
        x, y = np.nonzero(np.bitwise_count(a[i:i + rows, None] ^ b[None, :]) <= radius)
        yield x + i, y


def tile_links(fps: DataFrame, radius: int = MAX_DISTANCE, parts: int = PARTS,
               tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)``: forest edges that join all of the distinct ``fps.fp`` within the radius of each other."""
    key = F.concat_ws(",", *_part_counts(F.col("fp"), parts))
    # a tile of many fingerprints is cut by a hash into pieces of about tile_rows
    sized = fps.select("fp", key.alias("tile"))
    cuts = sized.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("cuts"))
    tiles = stored(sized.join(cuts, "tile")
                   .groupBy("tile", F.pmod(F.xxhash64("fp", F.lit(1)), "cuts").alias("cut"))
                   .agg(F.collect_list("fp").alias("fps")))
    steps = _steps(parts, radius)
    own = F.transform(F.split("tile", ","), lambda v: v.cast("int"))
    near = F.array(*[F.concat_ws(",", *[(F.element_at("counts", k + 1) + int(d)).cast("string")
                                        for k, d in enumerate(s)]) for s in steps])
    visits = (tiles.withColumn("counts", own)
              .select(F.col("tile").alias("from_tile"), F.col("cut").alias("from_cut"),
                      F.col("fps").alias("from_fps"), F.explode(near).alias("tile")))
    # only tiles that exist meet; within one tile each pair of pieces meets once
    pairs = (tiles.join(visits, "tile")
             .filter((F.col("tile") != F.col("from_tile")) | (F.col("cut") <= F.col("from_cut")))
             .select("fps", "from_fps"))

    def compare(batches):
        forest = Forest()
        for batch in batches:
            left, right = batch.column(0), batch.column(1)
            la, ra = np.diff(left.offsets.to_numpy()), np.diff(right.offsets.to_numpy())
            lv = left.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rv = right.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lo, ro = np.cumsum(la) - la, np.cumsum(ra) - ra
            work = la.astype(np.int64) * ra
            for i in np.flatnonzero(work > 4096):  # large tiles: one comparison each
                a, b = lv[lo[i]:lo[i] + la[i]], rv[ro[i]:ro[i] + ra[i]]
                for x, y in close_pairs(a, b, radius):
                    _join(forest, a[x], b[y])
            small = np.flatnonzero((work <= 4096) & (work > 0))
            for s, e in slices(work[small].tolist(), 1 << 20):  # small tiles: many at once
                rows = small[s:e]
                at = ragged_arange(work[rows])
                n = np.repeat(ra[rows], work[rows])
                x = np.repeat(lo[rows], work[rows]) + at // n
                y = np.repeat(ro[rows], work[rows]) + at % n
                hit = np.flatnonzero(np.bitwise_count(lv[x] ^ rv[y]) <= radius)
                _join(forest, lv[x[hit]], rv[y[hit]])
        edges = [(k, forest.find(k)) for k in forest.up]
        edges = np.array([e for e in edges if e[0] != e[1]], np.uint64).reshape(-1, 2)
        for i in range(0, len(edges), 50_000):
            part = edges[i:i + 50_000].copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])
        release_memory()

    return pairs.mapInArrow(compare, "a long, b long")


def _join(forest: Forest, a: np.ndarray, b: np.ndarray) -> None:
    different = a != b
    for x, y in zip(a[different].tolist(), b[different].tolist()):
        forest.join(x, y)


# ---- components ------------------------------------------------------------------

#: edges of one task in a round
EDGES_PER_TASK = 200_000


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(a, b)``: the smallest node that each can reach.

    Alternating large-star and small-star steps; each round is a written table,
    dealt by the edges of the round before (``rows``, where known, are those at first).
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges if rows is None else few_tasks(edges, rows, EDGES_PER_TASK))
    before, rows = None, edges.count()
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = least.select("a", F.col("m").alias("b"))
        both = few_tasks(small, rows, EDGES_PER_TASK).union(few_tasks(least, rows, EDGES_PER_TASK))
        edges = stored(few_tasks(both.distinct(), rows, EDGES_PER_TASK))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        before, rows = now, now[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def rooted_prints(prints: DataFrame, least: Column, radius: int = MAX_DISTANCE) -> DataFrame:
    """``(fp, root, least)`` of every distinct fingerprint in ``prints``; ``least`` is an aggregate of its rows."""
    fps = stored(prints.groupBy("fp").agg(least.alias("least")))  # copies meet here, pre-aggregated
    roots = components(tile_links(fps.select("fp"), radius))
    return (fps.join(roots, fps.fp == roots.node, "left")
            .select("fp", F.coalesce("root", "fp").alias("root"), "least"))


def simhash_classes(prints: DataFrame, radius: int = MAX_DISTANCE) -> DataFrame:
    """``(fp, component_id)`` of every distinct fingerprint in ``prints(doc_id, fp)``."""
    grouped = rooted_prints(prints, F.min("doc_id"), radius)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.select("fp", "root").join(least, "root").select("fp", "component_id")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            width: int = SHINGLE_WORDS, radius: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document."""
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), simhash64(F.col(text_col), width).alias("fp")))
    classes = simhash_classes(prints, radius)
    return (prints.join(classes, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


@small_batches
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


@small_batches
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest id, nulls last, and the first of equal ids."""
    fp, row = free_name(docs, "simhash_fp"), free_name(docs, "simhash_row")
    # stored, so that a row's number holds wherever it is read again
    rows = stored(docs.withColumn(fp, simhash64(F.col("text"))).withColumn(row, F.monotonically_increasing_id()))
    prints = rows.select(F.col("doc_id").alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    keep = rooted_prints(prints, least).groupBy("root").agg(F.min("least").alias("least"))
    keep = keep.select(F.col("least.row").alias(row))
    return rows.join(keep, row, "left_semi").select(*docs.columns)
