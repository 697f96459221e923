"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes.  Where tokens of both end is a cut, the
tokens between cuts are a group, and every overlap of an A token and a B token is a link.

1. Texts are packed into shards (a written table) and cut into units that both
   tokenizers treat by themselves: a space after a character that is surely
   not white space begins a unit.  Distinct units are tokenised and aligned once,
   many together: each end of a token (of either side) closes exactly one link.
2. A shard's links are inverted: per id pair a bitmap of its documents, with
   one plane for each binary digit of the number of times a document holds
   the pair.  Pairs of few documents are lists of steps, others bits; all are
   compressed and written once.  The planes OR-ed together are the documents.
3. Popcounts of the OR-merged planes are summed per pair (shards hold
   different documents), pre-aggregated; the largest per A id follows.
4. Each shard takes back the counts of its pairs, and its postings return them
   to the documents: a count goes to every document of a plane, times the
   plane's digit.

Defined results: a null or empty text, and one whose bytes a tokenizer does
not give back, has no tokens (zeros, empty digest) and holds no pair; ids may
be null or repeat, every row is a document of its own; a very long text is one
slice; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import ragged_arange, release_memory, slices, small_batches, stored, table
from lexiscope.llm.packing import BYTE_LETTERS
from lexiscope.llm.suffix_dedup import SHARD_BYTES, deflate, inflate, shard_table, squeeze, unsqueeze

SLICE_BYTES = 2 << 20
#: distinct units that a Python worker keeps, and the longest one kept
KEPT_UNITS = 400_000
KEPT_UNIT_BYTES = 256
NEW_UNITS = 50_000
SPACE = 32


def paths() -> tuple[str, str]:
    """The vocabulary files of the driver query; resolved where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- units ---------------------------------------------------------------------------

def unit_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin: at ``first`` and at spaces that follow a character that is surely not white space."""
    space = np.flatnonzero(data == SPACE)
    space = space[space >= 3]
    one, two, three = data[space - 1], data[space - 2], data[space - 3]
    follows = (one > SPACE) & (one < 0x7F)
    tail = (one >= 0x80) & (one < 0xC0)
    follows |= tail & (two >= 0xC3) & (two <= 0xDF)  # two bytes: U+00C0 and beyond
    follows |= tail & (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three <= 0xE9)  # East Asian letters
    return np.union1d(first, space[follows])


class Tokens:
    """Tokens of some units of one tokenizer: ids, units' token counts, and the ends of the tokens in the joined bytes."""

    def __init__(self, ids: list[list[int]], units: list[bytes], names: list[bytes], sizes: np.ndarray):
        self.count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter((i for own in ids for i in own), np.int64, int(self.count.sum()))
        given = [len(u) for u in units]
        total = np.concatenate([[0], np.cumsum(sizes[self.ids])])
        ends = np.cumsum(self.count)
        self.exact = total[ends] - total[ends - self.count] == given
        if not self.exact.all() or b"".join([names[i] for i in self.ids.tolist()]) != b"".join(units):
            for k, own in enumerate(ids):
                self.exact[k] = b"".join([names[i] for i in own]) == units[k]


class Aligner:
    """Aligned units of two tokenizers; distinct units are kept (up to a bound) from one call to the next."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.space = self.b.piece_to_id("▁")
        letters = {chr(v): k for k, v in BYTE_LETTERS.items()}
        n = self.a.get_vocab_size()
        self.a_names = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(n)]
        self.b_names = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in names], np.int64) for names in (self.a_names, self.b_names))
        # the text of an id and the mark after it, for each of the marks
        each = max(n, len(self.b_names))
        self.marked = pa.array([b"%d%s" % (i, m) for m in (b",", b"|", b";") for i in range(each)], pa.large_binary())
        self.each = each
        self.clear()

    def clear(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.groups = pa.array([], pa.large_binary())  # a unit's groups, each closed by ';'
        self.facts = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, exact
        self.lead = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def place(self, units: pa.Array) -> np.ndarray:
        """The number of each (distinct) unit, aligning those not known yet."""
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        for i in range(0, len(new), NEW_UNITS):
            part = new[i:i + NEW_UNITS]
            at[part] = np.arange(len(self.units), len(self.units) + len(part))
            self._learn(units.take(pa.array(part)))
        return at

    def _learn(self, units: pa.Array) -> None:
        raw = units.to_pylist()
        texts = [u.decode() for u in raw]
        encoded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        a = Tokens([e.ids for e in encoded], raw, self.a_names, self.a_sizes)
        # B puts a space before each text itself, but none before an empty one
        encoded = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = Tokens([ids or [self.space] for ids in encoded], raw, self.b_names, self.b_sizes)
        good = a.exact & b.exact
        size = np.where(good, [len(u) for u in raw], 0)
        limit = np.cumsum(size)
        ends_a, ends_b, ids_a, ids_b = *(_ends(t, good, s) for t, s in ((a, self.a_sizes), (b, self.b_sizes))), *(
            t.ids[np.repeat(good, t.count)] for t in (a, b))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.union1d(ends_a, ends_b)
        link = (ids_a[np.searchsorted(ends_a, ends)] << 32) | ids_b[np.searchsorted(ends_b, ends)]
        per = [np.diff(np.concatenate([[0], np.searchsorted(e, limit, side="right")])) for e in (cuts, ends)]
        facts = np.stack([a.count, b.count, *per, good], axis=1)
        # all ids in the order of the text form: by group, then side, then place
        group = np.concatenate([np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(2 * group + side, kind="stable")
        ids, group, side = np.concatenate([ids_a, ids_b])[order], group[order], side[order]
        mark = np.full(len(ids), 2)
        same = group[1:] == group[:-1]
        mark[:-1] = np.where(~same, 2, np.where(side[1:] == side[:-1], 0, 1))
        text = self.marked.take(pa.array(mark * self.each + ids))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        stops = np.concatenate([[0], np.cumsum(np.where(good, a.count + b.count, 0))])
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [
            None, pa.py_buffer(np.ascontiguousarray(offsets[stops])), text.buffers()[2]])
        self.units = pa.concat_arrays([self.units, units])
        self.groups = pa.concat_arrays([self.groups, strings])
        self.lead = np.concatenate([self.lead, len(self.links) + np.cumsum(per[1]) - per[1]])
        self.links = np.concatenate([self.links, link])
        self.facts = np.concatenate([self.facts, facts])

    def trim(self) -> None:
        if len(self.units) > KEPT_UNITS or (len(self.units) and self.units.nbytes > KEPT_UNITS * KEPT_UNIT_BYTES // 4):
            self.clear()


def _ends(t: Tokens, good: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[t.ids[np.repeat(good, t.count)]])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(given: tuple[str, str]) -> Aligner:
    """The aligner of this Python worker (workers outlive their tasks)."""
    if given not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[given] = Aligner(*given)
    return _ALIGNERS[given]


def align_texts(texts: list[bytes], by: Aligner) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text (A tokens, B tokens, groups, links) and the digest; then links as (pair, text, times), by pair and text."""
    facts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    none = np.zeros(0, np.int64)
    if not some:
        return facts, digests, none, none, none
    joined = b"".join(b" " + texts[k] for k in some)
    data = np.frombuffer(joined, np.uint8)
    size = np.array([len(texts[k]) + 1 for k in some], np.int64)
    ends = np.cumsum(size)
    starts = unit_starts(data, ends - size)
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets),
                                                                             pa.py_buffer(joined)]).dictionary_encode()
    by.trim()
    number = by.place(units.dictionary)[units.indices.to_numpy()]
    owner = np.searchsorted(ends, starts, side="right")
    lead = np.searchsorted(owner, np.arange(len(some)))
    own = np.add.reduceat(by.facts[number], lead, axis=0)
    good = own[:, 4] == np.diff(np.concatenate([lead, [len(number)]]))  # every unit gives its bytes back
    facts[some] = own[:, :4] * good[:, None]
    text = by.groups.take(pa.array(number))
    stop = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    view = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
    for k, g, a, z in zip(some, good.tolist(), stop[lead].tolist(), stop[np.append(lead[1:], len(number))].tolist()):
        if g:
            digests[k] = hashlib.sha256(view[a:z - 1]).hexdigest()
    # the same unit again in a text: once, with its times
    keep = good[owner]
    key, times = np.unique((owner[keep] << 32) | number[keep], return_counts=True)
    owner, number = key >> 32, key & 0xFFFFFFFF
    n = by.facts[number, 3]
    pair = by.links[np.repeat(by.lead[number], n) + ragged_arange(n)]
    doc, times = np.repeat(np.array(some, np.int64)[owner], n), np.repeat(times, n)
    order = np.lexsort((doc, pair))
    return facts, digests, *_summed(pair[order], doc[order], times[order])


def _summed(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return pair[at], doc[at], np.add.reduceat(times, at) if len(at) else times


# ---- postings ---------------------------------------------------------------------------

class Postings:
    """Pairs of a shard with their document bitmaps: one plane per binary digit of the times.

    A plane has the bits of its dense pairs and, for all others, (pair, document) in order.
    """

    def __init__(self, pairs: np.ndarray, docs: int, dense: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]]):
        self.pairs, self.docs, self.dense, self.planes = pairs, docs, dense, planes

    @classmethod
    def build(cls, pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> "Postings":
        """From links by pair and document, each (pair, document) once."""
        pairs, index, held = np.unique(pair, return_inverse=True, return_counts=True)
        dense = np.flatnonzero(held > max(1, docs // 16))
        place = np.full(len(pairs), -1, np.int64)
        place[dense] = np.arange(len(dense))
        planes = []
        for p in range(int(times.max()).bit_length() if len(times) else 0):
            on = (times >> p) & 1 == 1
            i, d = index[on], doc[on]
            bits = np.zeros((len(dense), docs), bool)
            thick = place[i] >= 0
            bits[place[i[thick]], d[thick]] = True
            planes.append((np.packbits(bits, axis=1), i[~thick] * docs + d[~thick]))
        return cls(pairs, docs, dense, planes)

    def document_counts(self) -> np.ndarray:
        """Documents of each pair: the popcount of its planes OR-ed together."""
        out = np.zeros(len(self.pairs), np.int64)
        if self.planes:
            bits = np.bitwise_or.reduce([b for b, _ in self.planes])
            out[self.dense] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            thin = self.planes[0][1]
            for _, more in self.planes[1:]:
                thin = np.union1d(thin, more) if len(more) else thin
            out += np.bincount(thin // self.docs, minlength=len(out))
        return out

    def returned(self, values: np.ndarray) -> np.ndarray:
        """Per document the sum over its links of their pair's value."""
        out = np.zeros(self.docs, np.int64)
        for p, (bits, thin) in enumerate(self.planes):
            value = values << p
            np.add.at(out, thin % self.docs, value[thin // self.docs])
            for a in range(0, len(bits), 256):  # bounded however many pairs are dense
                on = np.unpackbits(bits[a:a + 256], axis=1, count=self.docs).astype(np.int64)
                out += value[self.dense[a:a + 256]] @ on
        return out

    def packed(self) -> bytes:
        parts = [deflate(np.diff(self.pairs, prepend=0)), deflate(self.dense)]
        for bits, thin in self.planes:
            raw = bits.tobytes()
            parts += [len(raw).to_bytes(8, "little") + squeeze(raw), deflate(np.diff(thin, prepend=0))]
        return b"".join(len(x).to_bytes(8, "little") + x for x in parts)

    @classmethod
    def unpacked(cls, blob: bytes, docs: int) -> "Postings":
        parts, at = [], 0
        while at < len(blob):
            n = int.from_bytes(blob[at:at + 8], "little")
            parts.append(blob[at + 8:at + 8 + n])
            at += 8 + n
        steps = lambda b: np.cumsum(inflate(b, 1)[0].view(np.int64))
        dense, planes = inflate(parts[1], 1)[0].view(np.int64), []
        for raw, thin in zip(parts[2::2], parts[3::2]):
            size = int.from_bytes(raw[:8], "little")
            bits = np.frombuffer(unsqueeze(raw[8:], size) if size else b"", np.uint8)
            planes.append((bits.reshape(len(dense), -1) if len(dense) else bits.reshape(0, 0), steps(thin)))
        return cls(steps(parts[0]), docs, dense, planes)


# ---- Spark --------------------------------------------------------------------------------

FACTS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK = ("shard_id long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "digests array<string>, pairs binary, postings binary")


def pair_postings(shards: DataFrame, files: Callable[[], tuple[str, str]]) -> DataFrame:
    """Each shard's documents (arrays), its pairs with their document counts, and the postings."""
    def run(batches):
        for batch in batches:
            by = aligner(files())
            for k in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                data = unsqueeze(batch.column("data")[k].as_py(), sizes.sum())
                ends = np.cumsum(sizes)
                facts, digests, found = [], [], []
                for a, z in slices(sizes.tolist(), SLICE_BYTES):
                    texts = [data[e - n:e] for e, n in zip(ends[a:z].tolist(), sizes[a:z].tolist())]
                    own, names, pair, doc, times = align_texts(texts, by)
                    facts.append(own)
                    digests += names
                    found.append((pair, doc + a, times))
                pair, doc, times = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((doc, pair))  # documents of different slices: their bitmaps are OR-ed
                post = Postings.build(pair[order], doc[order], times[order], len(sizes))
                facts = np.concatenate(facts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard_id").slice(k, 1), batch.column("ids").slice(k, 1),
                     *[pa.array([facts[:, c]], pa.list_(pa.int64())) for c in range(4)],
                     pa.array([digests], pa.list_(pa.string())),
                     pa.array([deflate(np.diff(post.pairs, prepend=0), post.document_counts())], pa.binary()),
                     pa.array([post.packed()], pa.binary())], names=[f.split(" ")[0] for f in BLOCK.split(", ")])
            del by
        release_memory()

    return shards.select("shard_id", "ids", "sizes", "data").mapInArrow(run, BLOCK)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """``(shard_id, place, pair, n)``: the pairs of every shard with their number of documents there."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                steps, n = inflate(batch.column("pairs")[k].as_py(), 2)
                pair = np.cumsum(steps.view(np.int64))
                for a in range(0, len(pair), 100_000):
                    part = slice(a, a + 100_000)
                    size = len(pair[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, batch.column("shard_id")[k].as_py()), pa.int64()),
                         pa.array(np.arange(a, a + size), pa.int32()), pa.array(pair[part]),
                         pa.array(n[part].view(np.int64))], names=["shard_id", "place", "pair", "n"])

    return blocks.select("shard_id", "pairs").mapInArrow(run, "shard_id long, place int, pair long, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: documents that hold the pair, and whether that is its A id's highest."""
    counts = stored(_pair_rows(blocks).groupBy("pair").agg(F.sum("n").alias("count"))
                    .withColumn("a", F.shiftright("pair", 32)))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned_documents(docs: DataFrame, files: Callable[[], tuple[str, str]] = paths, id_col: str = "doc_id",
                      text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their scores, and the corpus table ``(pair, count, best)`` (pair: A id * 2^32 + B id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    shards = shard_table(docs, "doc_id", "text", max(parallel, ceil(total / (2 * SHARD_BYTES))))
    blocks = stored(pair_postings(shards, files))
    counts = stored(pair_counts(blocks))
    back = (_pair_rows(blocks).drop("n").join(counts, "pair").groupBy("shard_id")
            .agg(F.collect_list(F.struct("place", "count", "best")).alias("scores")))
    joined = blocks.drop("pairs").join(back, "shard_id", "left")
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids").slice(k, 1).flatten()
                post = Postings.unpacked(batch.column("postings")[k].as_py(), len(ids))
                values = np.zeros((2, len(post.pairs)), np.int64)
                scores = batch.column("scores").slice(k, 1).flatten()
                place = scores.field("place").to_numpy()
                values[0, place] = scores.field("best").to_numpy(zero_copy_only=False)
                values[1, place] = scores.field("count").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [ids, *[batch.column(c).slice(k, 1).flatten() for c in FACTS],
                     *[pa.array(post.returned(v)) for v in values], batch.column("digests").slice(k, 1).flatten()],
                    names=[f.split(" ")[0] for f in schema.split(", ")])
        release_memory()

    columns = ["ids", *FACTS, "digests", "postings", "scores"]
    return joined.select(*columns).mapInArrow(run, schema), counts


@small_batches
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))[0]
