"""Exact removal of repeated byte strings by per-shard suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(in a smaller doc_id, or earlier in the same document); strings are judged on
the input.  Documents are packed into shards of bounded size, a written table
that the later steps read in place.

1. Anchors.  Of the grams in every string (window) one is its anchor: that
   with the least hash, the leftmost of equals.  Equal windows have equal
   anchors at the same place, so a window can only repeat where its anchor
   repeats.  Each shard gives its anchors, sorted by hash, with a digest of the
   text that the anchor's windows cover; copies within a shard are one entry.
2. The shards' sorted anchor lists meet by hash range and are searched in the
   merged list (binary search).  An anchor that is alone is settled: nothing
   repeats.  One whose whole surroundings also stand earlier is settled: all
   its windows repeat.  Only first surroundings that differ from others of the
   same anchor are open.
3. Each shard builds a suffix array over its open text by Larsson-Sadakane
   refinement, takes common prefixes by Kasai's method, and settles windows
   that repeat inside the shard.  What is left goes out by anchor.
4. Windows of an anchor from all shards are merged by binary search in their
   sorted lists and verified byte by byte.  An anchor with more open text than
   ``hot_bytes`` is dealt by whole windows instead, so that no task gathers it.

Defined results: a null text is empty (nothing removed); a null doc_id counts
as larger than all others; rows that repeat a doc_id are ordered by their place
in the shard table (the first keeps its bytes); texts under ``length`` bytes
never change; an empty table gives no rows; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StructField, StructType
from xxhash import xxh3_64_digest

from lexiscope.llm.common import bucketed, ragged_arange, release_memory, slices, small_batches, stored, table, utf8

LENGTH = 100
SHARD_BYTES = 8 << 20
#: open text whose suffixes are sorted at once (or one region): sorting takes about 40 times that
OPEN_BYTES = 4 << 20
ANCHOR_SLICE = 256 << 10
BUCKET_ANCHORS = 400_000
MERGE_BYTES = 2 << 20
HOT_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max

UNIQUE, REPEATED, OPEN = 0, 1, 2


# ---- numpy: suffix arrays -----------------------------------------------------------

def words_at(data: np.ndarray, past: int = 0) -> np.ndarray:
    """The eight bytes from each position and ``past`` more, big-endian (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8 + past, np.uint8)])
    return np.ndarray((len(data) + past,), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that start there (Larsson-Sadakane).

    Sorted by eight bytes first; then groups of equals are sorted by the group
    numbers found 8, 16, 32 ... bytes on, sorted positions being left alone.
    Texts are under 2 GB, so positions take four bytes.
    """
    n = len(data)
    key = words_at(data)
    order = np.argsort(key[::-1], kind="stable").astype(np.int32)
    np.subtract(n - 1, order, out=order)  # of equal bytes the later position first: the shorter one, if zeros stand past the end

    def starts(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
        first = np.where(new, slots, np.int32(0))
        return np.maximum.accumulate(first, out=first)

    def changes(sorted_key: np.ndarray) -> np.ndarray:
        new = np.ones(len(sorted_key), bool)
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        return new

    group = np.empty(n + 1, np.int32)
    group[n] = -1  # past the end
    if n:
        new = changes(key[order])
        del key
        new[1:] |= order[:-1] > n - 8  # suffixes under eight bytes equal no other
        group[order] = starts(new, np.arange(n, dtype=np.int32))
    h = 8
    while n:
        alone = changes(group[order])  # groups lie together: alone is what differs from both neighbours
        alone[:-1] &= alone[1:]
        todo = np.flatnonzero(~alone).astype(np.int32)
        if not len(todo):
            break
        at = order[todo]
        key = group[at].astype(np.uint64)
        key <<= np.uint64(32)
        key |= (group[np.minimum(at.astype(np.int64) + h, n)] + 1).astype(np.uint64)
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        del o
        order[todo] = at
        group[at] = starts(changes(key), todo)
        h *= 2
    return order


def kasai(data: np.ndarray, order: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix (up to ``cap``) of each suffix in ``order`` with the one before it.

    Kasai's walk over text positions keeps the last prefix less one; here many
    stretches of the text are walked in step, eight bytes to a comparison.
    """
    n = len(data)
    out = np.zeros(n, np.min_scalar_type(cap))
    if n == 0:
        return out
    word = words_at(data, 1)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    bounds = np.linspace(0, n, min(lanes, n) + 1).astype(np.int64)
    i, stop = bounds[:-1].copy(), bounds[1:]
    h = np.zeros(len(i), np.int64)
    steps = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
    while len(i):
        j = before[i].astype(np.int64)
        x = word[np.minimum(i + h, n)] ^ word[np.minimum(np.maximum(j, 0) + h, n)]
        same = 7 - np.searchsorted(steps, x, side="right")  # equal leading bytes, if any differ
        h = h + np.where(x == 0, 8, same)
        room = np.minimum(cap, n - np.maximum(i, j))
        done = (x != 0) | (h >= room) | (j < 0)
        out[i[done]] = np.where(j[done] < 0, 0, np.minimum(h[done], room[done]))
        h = np.where(done, np.maximum(np.where(j < 0, 0, np.minimum(h, room)) - 1, 0), h)
        i = i + done
        going = i < stop
        if not going.all():
            i, stop, h = i[going], stop[going], h[going]
    return out[order]


def first_of_equals(data: np.ndarray, starts_ok: np.ndarray, length: int) -> np.ndarray:
    """For each position where a window may start: does an equal window start earlier in ``data``?"""
    order = suffix_array(data)
    prefix = kasai(data, order, length)
    group = np.cumsum(prefix < length, dtype=np.int32)
    group -= 1
    valid = starts_ok[order]
    first = np.full(group[-1] + 1 if len(group) else 0, len(data), np.int32)
    np.minimum.at(first, group[valid], order[valid])
    later = np.zeros(len(data), bool)
    later[order] = valid & (order > first[group])
    return later


# ---- numpy: anchors ------------------------------------------------------------------

_BYTE = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=8).digest(), "big") for b in range(256)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_size(length: int) -> int:
    return 1 << max(0, (length // 2).bit_length() - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from each position, by doubling."""
    h, d = _BYTE[data], 1
    while d < size:
        if len(h) <= d:
            return h[:0]
        g = h[:-d] * _MIX
        g += h[d:]
        h = g ^ (g >> np.uint64(29))
        d *= 2
    return h


def window_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Anchors of all windows inside documents: (document, gram hash, first window, last window).

    ``starts``/``ends`` bound the documents in ``data`` (under 4 GB).  An
    anchor's windows follow one another.  Grams are ordered by half of their
    hash, equals by position, so the anchor depends on the window's text alone.
    """
    size = gram_size(length)
    h = gram_hashes(data, size)
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, h[:0], empty, empty
    low = np.uint64(0xFFFFFFFF)
    least, d, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - size + 1
    while d < span:
        k = min(d, span - d)
        least = np.minimum(least[k:], least[:-k])
        d += k
    anchor = (least & low).astype(np.uint32)
    inside = np.zeros(len(anchor) + 1, bool)
    for a, z in zip(starts.tolist(), (ends - length + 1).tolist()):
        inside[a:max(a, z)] = True
    change = anchor[1:] != anchor[:-1]
    # two documents never share an anchor, and windows across them are not inside
    first = np.flatnonzero(inside[:-1] & np.concatenate([[True], change | ~inside[:-2]]))
    last = np.flatnonzero(inside[:-1] & np.concatenate([change | ~inside[1:-1], [True]]))
    return np.searchsorted(ends, first, side="right"), h[anchor[first]], first, last


class Shard:
    """One row of the shard table: its texts and their anchors in the order of the hash."""

    def __init__(self, shard_id: int, ids: list, sizes: np.ndarray, data: bytes, length: int):
        self.shard_id, self.length, self.data = shard_id, length, data
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(data, np.uint8)
        parts = []
        for a, z in slices(sizes.tolist(), ANCHOR_SLICE):
            base = self.starts[a]
            d, h, s0, s1 = window_anchors(self.bytes[base:self.ends[z - 1]], self.starts[a:z] - base,
                                          self.ends[a:z] - base, length)
            parts.append((d + a, h, s0 + base, s1 + base))
        self.doc, least, self.first, self.last = (np.concatenate(x) for x in zip(*parts))
        self.hash = least * _MIX  # anchors have small hashes: spread them again for the buckets
        self.hash ^= self.hash >> np.uint64(32)
        self.hash *= _MIX
        digest = [xxh3_64_digest(data[a:z]) for a, z in zip(self.first.tolist(), (self.last + length).tolist())]
        self.digest = np.frombuffer(b"".join(digest), np.uint64)
        # entries: by hash, then surroundings, then document order; only the first of equals counts
        place = np.empty(len(self.ids), np.int64)
        place[np.lexsort((np.arange(len(self.ids)), self.ids))] = np.arange(len(self.ids))
        order = np.lexsort((self.first, place[self.doc], self.digest, self.hash))
        h, d = self.hash[order], self.digest[order]
        lead = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
        self.entries, self.copies, self.place = order[lead], order[~lead], place


def bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket (equal range of hashes) begins and ends in sorted hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueeze(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, int(size), asbytes=True)


def deflate(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, their bytes transposed, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + squeeze(raw)


def inflate(blob: bytes, n_columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(unsqueeze(blob[8:], n * 8 * n_columns), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, -1).T).view(np.uint64).ravel() for c in np.split(raw, n_columns)]


def merge_anchors(shards: np.ndarray, blobs: list[bytes]) -> list[np.ndarray]:
    """A code for every entry of every shard's sorted list: unique, repeated or open."""
    lists = [inflate(b, 4) for b in blobs]
    merged = np.sort(np.concatenate([x[0] for x in lists]))
    again = []
    for hashes, *_ in lists:  # binary search of each shard's list in the merged one
        again.append(np.searchsorted(merged, hashes, "right") - np.searchsorted(merged, hashes, "left") > 1)
    hashes, digests, ids, places = (np.concatenate([x[k][a] for x, a in zip(lists, again)]) for k in range(4))
    owner = np.repeat(shards, [int(a.sum()) for a in again])
    order = np.lexsort((places, owner, ids.view(np.int64), digests, hashes))
    h, d = hashes[order], digests[order]
    new_hash = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    lead = new_hash | np.concatenate([[True], d[1:] != d[:-1]]) if len(h) else new_hash
    number = np.cumsum(new_hash) - 1
    kinds = np.bincount(number, weights=lead) if len(h) else np.zeros(0)
    code = np.where(~lead, REPEATED, np.where(kinds[number] > 1, OPEN, UNIQUE)).astype(np.uint8)
    back = np.empty(len(h), np.uint8)
    back[order] = code
    out, at = [], 0
    for a in again:
        codes = np.zeros(len(a), np.uint8)
        n = int(a.sum())
        codes[a] = back[at:at + n]
        at += n
        out.append(codes)
    return out


# ---- Spark ------------------------------------------------------------------------------

def shard_table(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``(shard_id, ids, sizes, rest, data)``: the documents in shards of about ``SHARD_BYTES``."""
    rest = [c for c in docs.columns if c != text_col]
    chosen = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"),
                         F.struct(*[docs[c] for c in rest]).alias("rest"))
    schema = StructType([StructField("shard_id", LongType()), StructField("ids", ArrayType(LongType())),
                         StructField("sizes", ArrayType(LongType())),
                         StructField("rest", ArrayType(chosen.schema["rest"].dataType)),
                         StructField("data", BinaryType())])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, z in slices([len(t) for t in texts], SHARD_BYTES):
                ends = pa.array([0, z - a], pa.int32())
                data = b"".join(texts[a:z])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(ends, batch.column(0).slice(a, z - a)),
                    pa.array([[len(t) for t in texts[a:z]]], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(ends, batch.column(2).slice(a, z - a)),
                    pa.array([squeeze(data)], pa.binary())], names=schema.names)
                number += 1
        release_memory()

    return bucketed(chosen.mapInArrow(run, schema), "shard_id", buckets)


def _shards(batch: pa.RecordBatch, length: int):
    for k in range(batch.num_rows):
        sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
        data = unsqueeze(batch.column("data")[k].as_py(), sizes.sum())
        yield k, Shard(batch.column("shard_id")[k].as_py(), batch.column("ids")[k].as_py(), sizes, data, length)


def anchor_codes(shards: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(shard_id, bucket, codes)`` for the entries of every shard, from all shards' sorted lists."""
    def give(batches):
        for batch in batches:
            for _, s in _shards(batch, length):
                e = s.entries
                cut = bucket_bounds(s.hash[e], buckets)
                # owners are ordered by (doc_id, shard, place in the shard)
                where = (s.place[s.doc[e]] << 32) + (s.first[e] - s.starts[s.doc[e]])
                rows = [(k, deflate(s.hash[e[a:z]], s.digest[e[a:z]], s.ids[s.doc[e[a:z]]], where[a:z]))
                        for k, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in rows], pa.int64()), pa.array([s.shard_id] * len(rows), pa.int64()),
                         pa.array([b for _, b in rows], pa.binary())], names=["bucket", "shard_id", "list"])
        release_memory()

    def merge(lists: pa.Table) -> pa.Table:
        codes = merge_anchors(lists["shard_id"].to_numpy(), lists["list"].to_pylist())
        return pa.table({"shard_id": lists["shard_id"], "bucket": lists["bucket"],
                         "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

    lists = shards.select("shard_id", "ids", "sizes", "data").mapInArrow(
        give, "bucket long, shard_id long, list binary")
    return lists.groupBy("bucket").applyInArrow(merge, "shard_id long, bucket long, codes binary")


FOUND = "kind int, shard_id long, doc int, id long, hash long, start long, stop long, data binary"
_RUN, _OPEN = 0, 1


def _runs(flags: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of set flags over which every key goes on (plus one each, or the same)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = at[1:] != at[:-1] + 1
    for k in keys:
        new |= k[at[1:]] != k[at[:-1]]
    lead = np.concatenate([[True], new])
    return at[lead], at[np.concatenate([lead[1:], [True]])]


def settle_shards(shards: DataFrame, codes: DataFrame, length: int, buckets: int) -> DataFrame:
    """Removed runs (kind 0) and the windows still open (kind 1), by anchor."""
    per_shard = codes.groupBy("shard_id").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))
    joined = shards.select("shard_id", "ids", "sizes", "data").join(per_shard, "shard_id")

    def settle(batches):
        for batch in batches:
            for k, s in _shards(batch, length):
                code = np.full(len(s.hash), REPEATED, np.uint8)  # copies inside the shard
                known = np.zeros(len(s.entries), np.uint8)
                cut = bucket_bounds(s.hash[s.entries], buckets)
                for c in batch.column("codes")[k].as_py():
                    known[cut[c["bucket"]]:cut[c["bucket"] + 1]] = np.frombuffer(c["codes"], np.uint8)
                code[s.entries] = known
                # a copy of open surroundings in its own shard is settled; its first stays open
                yield from _settled(s, code, length)
        release_memory()

    return joined.mapInArrow(settle, FOUND)


def _settled(s: Shard, code: np.ndarray, length: int):
    rows: list[tuple] = []
    a, z = _runs(code == REPEATED, s.doc)
    for d, start, stop in zip(s.doc[a].tolist(), s.first[a].tolist(), (s.last[z] + length).tolist()):
        rows.append((_RUN, d, start, stop, None))
    # open text: regions of consecutive open windows, laid out in document order
    a, z = _runs(code == OPEN, s.doc)
    if len(a):
        by = np.lexsort((s.first[a], s.place[s.doc[a]]))
        a, z = a[by], z[by]
        for i, j in slices((s.last[z] + length - s.first[a]).tolist(), OPEN_BYTES):
            rows += _sorted_open(s, a[i:j], z[i:j], length)
    for i in range(0, len(rows), 20_000):
        part = rows[i:i + 20_000]
        kind, d, b, e, w = (list(c) for c in zip(*part))
        base = s.starts[d]
        yield pa.RecordBatch.from_arrays([
            pa.array(kind, pa.int32()), pa.array([s.shard_id] * len(part), pa.int64()), pa.array(d, pa.int32()),
            pa.array(s.ids[d], pa.int64()),
            pa.array([None if x is None else int(s.hash[x].view(np.int64)) for x in w], pa.int64()),
            pa.array(np.array(b) - base, pa.int64()), pa.array(np.array(e) - base, pa.int64()),
            pa.array([None if x is None else s.data[p:q] for x, p, q in zip(w, b, e)], pa.binary())],
            names=["kind", "shard_id", "doc", "id", "hash", "start", "stop", "data"])


def _sorted_open(s: Shard, a: np.ndarray, z: np.ndarray, length: int) -> list[tuple]:
    """Rows of the regions from anchor ``a`` to anchor ``z``: what repeats inside them goes, the rest stays open.

    Windows that other regions of the shard hold too stay open and meet with those of other shards.
    """
    start = s.first[a].astype(np.int32)
    size = (s.last[z] + length).astype(np.int32) - start
    ends = np.cumsum(size, dtype=np.int32)
    offset = np.arange(ends[-1], dtype=np.int32)
    offset -= np.repeat(ends - size, size)
    may_start = offset <= np.repeat(size - np.int32(length), size)
    at = offset  # position in the shard of each laid-out byte
    at += np.repeat(start, size)
    later = first_of_equals(s.bytes[at], may_start, length)
    region = np.repeat(np.arange(len(a), dtype=np.int32), size)
    x, y = _runs(later, region)
    rows = [(_RUN, d, b, e, None) for d, b, e in zip(s.doc[a[region[x]]].tolist(), at[x].tolist(),
                                                     (at[y] + length).tolist())]
    del region
    # which anchor each window has: anchors follow one another without a gap inside a region
    anchors = np.concatenate([np.arange(i, j + 1, dtype=np.int32) for i, j in zip(a.tolist(), z.tolist())])
    anchor = np.full(len(at), -1, np.int32)
    anchor[may_start] = np.repeat(anchors, (s.last - s.first + 1)[anchors])
    x, y = _runs(may_start & ~later, anchor)
    rows += [(_OPEN, d, b, e, w) for d, b, e, w in zip(s.doc[anchor[x]].tolist(), at[x].tolist(),
                                                       (at[y] + length).tolist(), anchor[x].tolist())]
    return rows


def merge_windows(rows: pa.Table, length: int) -> pa.Table:
    """Windows of the open text of some anchors that stand earlier in another shard."""
    data = rows["data"].to_pylist()
    sizes = np.array([len(x) for x in data], np.int64)
    shard, doc, ids, start = (rows[c].to_numpy() for c in ("shard_id", "doc", "id", "start"))
    order = np.lexsort((start, doc, shard, ids))  # document order over all shards
    buffer = np.frombuffer(b"".join(data), np.uint8)
    wide = np.int32 if len(buffer) < 1 << 31 else np.int64
    base = (np.cumsum(sizes) - sizes).astype(wide)
    count = sizes - length + 1
    rank = np.empty(len(data), wide)
    rank[order] = (np.cumsum(count[order]) - count[order])
    owner = np.repeat(np.arange(len(data), dtype=np.int32), count)
    offset = ragged_arange(count).astype(wide)
    at = base[owner] + offset
    when = rank[owner] + offset
    size = gram_size(length)
    gram = gram_hashes(buffer, size)
    name = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - size, size), length - size]:  # grams that cover the window
        name ^= gram[at + k]
        name *= _MIX
        name ^= name >> np.uint64(31)
    del gram
    by = np.lexsort((when, name)).astype(wide)
    merged, firsts = name[by], by
    later = np.zeros(len(at), bool)
    word = words_at(buffer)
    steps = [*range(0, length - 8, 8), max(0, length - 8)]
    number = np.unique(shard, return_inverse=True)[1].astype(np.int32)[owner]
    by_shard = np.argsort(number, kind="stable").astype(wide)
    for mine in np.split(by_shard, np.flatnonzero(np.diff(number[by_shard])) + 1):
        # binary search of each shard's windows in the merged list
        first = firsts[np.searchsorted(merged, name[mine], "left")]
        hit = when[first] < when[mine]
        mine, first = mine[hit], first[hit]
        same = np.ones(len(mine), bool)
        for k in steps if length >= 8 else []:  # verify
            same &= word[at[mine] + k] == word[at[first] + k]
        for k in range(length) if length < 8 else []:
            same &= buffer[at[mine] + k] == buffer[at[first] + k]
        later[mine[same]] = True
        for w in mine[~same].tolist():  # equal names of unequal windows: look at all of them
            lo, hi = np.searchsorted(merged, name[w], "left"), np.searchsorted(merged, name[w], "right")
            own = buffer[at[w]:at[w] + length].tobytes()
            later[w] = any(when[v] < when[w] and buffer[at[v]:at[v] + length].tobytes() == own
                           for v in by[lo:hi].tolist())
    x, y = _runs(later, owner)
    return pa.table({"shard_id": pa.array(shard[owner[x]], pa.int64()), "doc": pa.array(doc[owner[x]], pa.int32()),
                     "start": pa.array(start[owner[x]] + offset[x], pa.int64()),
                     "stop": pa.array(start[owner[x]] + offset[y] + length, pa.int64())})


RUN = "shard_id long, doc int, start long, stop long"


def merge_open(found: DataFrame, length: int, hot_bytes: int) -> DataFrame:
    """Removed runs from the open windows of all shards."""
    still = found.filter(F.col("kind") == _OPEN).select("hash", "shard_id", "doc", "id", "start", "data")
    sizes = still.groupBy("hash").agg(F.sum(F.octet_length("data")).alias("size"), F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.filter("n > 1"))
    total = sizes.filter(F.col("size") <= hot_bytes).agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // MERGE_BYTES))
    met = still.join(sizes.select("hash", "size"), "hash")
    usual = met.filter(F.col("size") <= hot_bytes).withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    merged = usual.drop("size").groupBy("bucket").applyInArrow(lambda rows: merge_windows(rows, length), RUN)
    # the exact way for anchors with more text: every window by itself, pre-aggregated
    place = F.explode(F.sequence(F.lit(0), F.octet_length("data") - length)).alias("k")
    windows = (met.filter(F.col("size") > hot_bytes)
               .select("shard_id", "doc", "id", "start", "data", place)
               .select("shard_id", "doc", "id", (F.col("start") + F.col("k")).alias("start"),
                       F.expr(f"substring(data, k + 1, {length})").alias("window")))
    owner = F.struct("id", "shard_id", "doc", "start")
    first = windows.groupBy("window").agg(F.min(owner).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = (windows.join(first, "window").filter(owner != F.col("first"))
           .select("shard_id", "doc", "start", (F.col("start") + length).alias("stop")))
    return merged.unionByName(hot)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` without the text, as struct ``rest``, with ``n_bytes``, removed ``spans`` and the ``kept`` bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    shards = shard_table(docs, id_col, text_col, max(parallel, -(-total // (2 * SHARD_BYTES))))
    density = (length - gram_size(length) + 2) / 2
    buckets = max(parallel, int(total / density / BUCKET_ANCHORS) + 1)
    found = stored(settle_shards(shards, anchor_codes(shards, length, buckets), length, buckets))
    runs = (found.filter(F.col("kind") == _RUN).select("shard_id", "doc", "start", "stop")
            .unionByName(merge_open(found, length, hot_bytes)))
    return apply_runs(shards, runs).drop("owners")


def apply_runs(shards: DataFrame, runs: DataFrame) -> DataFrame:
    """``(rest, n_bytes, spans, kept, owners)`` of every document after its ``runs`` are cut.

    ``runs(shard_id, doc, start, stop[, owner])`` may overlap and come in any
    order; ``owners`` lists a document's distinct ``owner`` values.
    """
    if "owner" not in runs.columns:
        runs = runs.withColumn("owner", F.lit(None).cast("long"))
    per_shard = runs.groupBy("shard_id").agg(F.collect_list(F.struct("doc", "start", "stop", "owner")).alias("runs"))
    joined = shards.join(per_shard, "shard_id", "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = StructType([
        StructField("rest", shards.schema["rest"].dataType.elementType),
        *DataType.fromDDL("n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, owners array<long>"
                          ).fields])

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                data = unsqueeze(batch.column("data")[k].as_py(), sizes.sum())
                own_runs = batch.column("runs")[k].values
                spans, owners = [[] for _ in sizes], [set() for _ in sizes]
                if own_runs is not None:
                    doc, start, stop = (own_runs.field(c).to_numpy() for c in ("doc", "start", "stop"))
                    by = np.lexsort((start, doc))
                    for d, a, z in zip(doc[by].tolist(), start[by].tolist(), stop[by].tolist()):
                        own = spans[d]
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(z, own[-1][1])
                        else:
                            own.append([a, z])
                    for d, owner in zip(doc.tolist(), own_runs.field("owner").to_pylist()):
                        if owner is not None:
                            owners[d].add(owner)
                base = np.cumsum(sizes) - sizes
                kept = []
                for b, n, own in zip(base.tolist(), sizes.tolist(), spans):
                    edges = [0, *(x for s in own for x in s), n]
                    kept.append(b"".join(data[b + p:b + q] for p, q in zip(edges[::2], edges[1::2])))
                rest = batch.column("rest").slice(k, 1).flatten()
                out = [rest, pa.array(sizes), pa.array([[{"start": a, "stop": z} for a, z in s] for s in spans], span),
                       pa.array(kept, pa.binary()), pa.array([sorted(o) for o in owners], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
        release_memory()

    return joined.select("rest", "sizes", "data", "runs").mapInArrow(cut, schema)


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


@small_batches
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("rest.doc_id", "n_bytes", removed_bytes(F.col("spans")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@small_batches
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what is left of their text; those of which nothing is left go.

    A character cut through by a removed string loses its remaining bytes too.
    """
    done = remove_repeats(docs).filter((F.size("spans") == 0) | (F.octet_length("kept") > 0))

    def decode(kept: pa.Array) -> pa.Array:
        return pa.array([b.decode(errors="ignore") for b in kept.to_pylist()], pa.string())

    decode.__annotations__ = {"kept": pa.Array, "return": pa.Array}
    text = F.when(F.size("spans") > 0, F.arrow_udf(decode, "string")("kept")).otherwise(F.decode("kept", "UTF-8"))
    done = done.select("rest", "spans", text.alias("text"))
    return done.select(*[
        F.col("text") if c == "text"
        else F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col(f"rest.`{c}`"))
        .cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
