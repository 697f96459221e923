"""Tokenise documents and pack them into sequences of bounded length (best-two-fit).

A bin is filled greedily with the longest piece that still fits.  Then its
smallest piece makes room: two unpacked pieces that fill the gap plus the
smallest piece more tightly replace it, as often as that gains anything.

Only lengths decide, so pieces are dealt by a hash of their row to groups of a
fixed size and every group is packed by itself: the loss is a part of one
sequence per group, the memory of a task is bounded, and no key is hot.

Defined results: a null text is empty (one piece: the closing id); ids may be
null or repeat, every input row gives its own pieces; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from lexiscope.llm.common import ragged_arange, release_memory, small_batches, stored, table, text_slices

SEQUENCE_TOKENS = 2048
END_ID = 0
GROUP_PIECES = 50_000
#: distinct words that a Python worker keeps the ids of
CACHED_WORDS = 250_000


def word_bpe_path() -> str:
    """The vocabulary file of the driver query; resolved where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_BLANK = np.isin(np.arange(256), [*b" \t\n\r\v\f"])
#: a lower-case word of Latin-1 letters, and at most one sentence mark
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:]?)")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, all others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def byte_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(BYTE_LETTERS)


class WordTokenizer:
    """Ids of whole texts from a tokenizer whose words never cross ASCII white space.

    Each distinct word is encoded once and its ids are kept (up to a bound).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,!?;:"}
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.large_binary())  # a word's place here is that of its starts and sizes
        self.plain: dict[str, list[int]] = {}  # ids of lower-case Latin words
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > CACHED_WORDS:
            self._clear()
        text = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = _BLANK[text]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(text) and not blank[0]:
            edges = np.concatenate([[0], edges])
        starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[~blank])]).dictionary_encode()
        at = pc.fill_null(pc.index_in(words.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.words), len(self.words) + len(new))
            self._learn(words.dictionary.take(pa.array(new)))
        at = at[words.indices.to_numpy()] if len(starts) else at
        counts = self.sizes[at]
        ids = self.ids[np.repeat(self.starts[at], counts) + ragged_arange(counts)]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]
        return [ids[a:z] for a, z in zip(ends[:-1], ends[1:])]

    def _learn(self, words: pa.Array) -> None:
        """Encode new words: Latin words (and one sentence mark after) by the model, all others together."""
        new = words.to_pylist()
        plain, model, match = self.plain, self.tokenizer.model, _PLAIN.fullmatch
        if len(plain) > CACHED_WORDS // 10:
            plain.clear()
        found: list[list[int] | None] = []
        others: list[int] = []
        for k, w in enumerate(new):
            m = match(w.decode().lower())
            if m:  # normalising leaves such a word as it is, and the mark is a word of its own
                core, mark = m.groups()
                ids = plain.get(core)
                if ids is None:
                    ids = plain[core] = [t.id for t in model.tokenize(core if core.isascii() else byte_letters(core))]
                found.append(ids + self.marks[mark] if mark else ids)
            else:
                found.append(None)
                others.append(k)
        for i in range(0, len(others), 20_000):
            part = others[i:i + 20_000]
            texts = [new[k].decode() for k in part]
            lengths = np.array([len(t) + 1 for t in texts], np.int64)
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = e.ids
            first = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
            bounds = np.searchsorted(first, np.concatenate([[0], np.cumsum(lengths)]))
            for k, a, z in zip(part, bounds[:-1].tolist(), bounds[1:].tolist()):
                found[k] = ids[a:z]
        self.words = pa.concat_arrays([self.words, words])
        sizes = np.array([len(f) for f in found], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))])


def token_pieces(docs: DataFrame, path: str | Callable[[], str] = word_bpe_path, id_col: str = "doc_id",
                 text_col: str = "text", max_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the ids (little-endian 32-bit) of each text and its closing id.

    Only texts of more than ``max_tokens`` ids are cut.
    """
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = StructType([chosen.schema["doc_id"], *DataType.fromDDL(
        "piece int, start long, length long, ids binary").fields])

    def run(batches):
        tokenizer = WordTokenizer(path() if callable(path) else path)
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(1), 4 << 20):
                row, piece, start, length, ids = [], [], [], [], []
                for k, own in enumerate(tokenizer.encode(part), at):
                    own = np.append(own, np.uint32(END_ID)).astype("<u4", copy=False)
                    for n, s in enumerate(range(0, len(own), max_tokens)):
                        row.append(k)
                        piece.append(n)
                        start.append(s)
                        length.append(min(max_tokens, len(own) - s))
                        ids.append(own[s:s + max_tokens].tobytes())
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=schema.names)
        del tokenizer
        release_memory()

    return chosen.mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; all lengths are 1..capacity."""
    left = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # longest unpacked length up to each size

    def take(n: int, by: int = -1) -> None:
        left[n] += by
        if left[n] == 0 or (by > 0 and left[n] == by):
            after = n + 1 + np.searchsorted(fits[n + 1:], n, side="right") if by < 0 else None
            if by < 0:
                fits[n:after] = fits[n - 1]
            else:
                np.maximum(fits[n:], n, out=fits[n:])

    bins: list[list[int]] = []
    while fits[capacity]:
        held, gap = [], capacity
        while n := int(fits[gap]):
            held.append(n)
            gap -= n
            take(n)
        while gap and fits[capacity]:
            small = min(held)
            room = gap + small
            x = np.flatnonzero(left[:room])
            y = fits[room - x]
            same = (x == y) & (left[x] < 2)
            y = np.where(same, fits[np.maximum(x - 1, 0)], y)
            total = np.where(y > 0, x + y, 0)
            if not len(x) or total.max() <= small:
                break
            best = int(total.argmax())
            a, b = int(x[best]), int(y[best])
            held.remove(small)
            held += [a, b]
            gap = room - a - b
            take(a)
            take(b)
            take(small, 1)
        bins.append(held)
    counts = np.array([len(b) for b in bins], np.int64)
    flat = np.array([n for b in bins for n in b], np.int64)
    number = np.repeat(np.arange(len(bins)), counts)
    before = np.cumsum(flat) - flat
    offset = before - np.repeat(before[np.cumsum(counts) - counts], counts) if len(flat) else before
    slots, rows = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
    of, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    of[rows], at[rows] = number[slots], offset[slots]
    return of, at


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = SEQUENCE_TOKENS,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: its place in a sequence, gapless from 0.

    ``pieces`` should be a stored table, as it is counted first.
    """
    groups = max(1, round(pieces.count() / group_pieces))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))

    def run(key, rows):
        of, at = best_two_fit(rows[length_col].to_numpy(np.int64), capacity)
        return rows.drop(columns="pack_group").assign(sequence_id=(int(key[0]) << 32) + of, offset=at)

    return pieces.withColumn("pack_group", deal).groupBy("pack_group").applyInPandas(run, schema)


@small_batches
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Every piece of ``docs`` with its checksum and place (the ids themselves: ``token_pieces``)."""
    pieces = token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(pieces))


@small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)
