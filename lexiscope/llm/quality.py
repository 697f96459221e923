"""Quality rules by distribution divergence.

Every language gets a reference from all its documents: a histogram of
character classes, one of its most common words and one of ASCII marks (each
symbol and separator its own bin, all other characters one more).  A document
is compared with the reference of its declared language by the Jensen-Shannon
distance (base 2, so 0..1) of each histogram; short documents are guarded,
because their histograms are noise.

A fence is Q3 + ``FENCES`` x (Q3 - Q1) of distances (rounded to 4 decimals, so the
counts behind the quartiles are bounded), at most the fixed limit.  The limit of a
language weighs three by one rule for every size: its own fence by its ``n`` distances,
and the corpus's limit by ``PRIOR_DOCUMENTS``; the corpus's limit weighs the fence of
all distances and the fixed limit in the same way.

Defined results: a null text is an empty text; null languages form a group of
their own; an empty table gives no rows; repeated rows are judged one by one;
other columns of the input are ignored (whatever their names).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import release_memory, small_batches, stored, table, text_slices

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: character classes: lower, upper, digit, blank, sentence marks, symbols, other ASCII, non-ASCII
N_CLASSES = 8
#: the marks that have a bin each
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: interquartile ranges above the third quartile that a distance may lie; word histograms of clean texts spread widely
#: with their length, the other two hardly (chosen on labelled documents of even doc_id, judged on the odd ones)
FENCES = {"char_distance": 20.0, "word_distance": 3.0, "mark_distance": 15.0}
#: weight, in documents, of the wider limit against a group's own fence; least distance between the quartiles
PRIOR_DOCUMENTS, LEAST_SPREAD = 20, 0.001


def _classes() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    t[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
    t[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
    t[[*b"0123456789"]] = 2
    t[[*b" \t\n\r\v\f"]] = 3
    t[[*b".,;:?!'\"()-"]] = 4
    t[[*SYMBOLS]] = 5
    t[0x80:0xC0] = N_CLASSES  # continuation bytes: counted with their lead byte
    t[0xC0:] = 7
    return t


def _marks() -> np.ndarray:
    t = np.full(256, len(MARKS), np.uint8)
    t[[*MARKS]] = np.arange(len(MARKS))
    t[0x80:0xC0] = len(MARKS) + 1
    return t


CLASS = _classes()
MARK = _marks()
#: letters, digits and non-ASCII bytes stay (lower-cased); all else parts words
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
             for c in range(256))


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def mark_counts(data: bytes) -> np.ndarray:
    return np.bincount(MARK[np.frombuffer(data, np.uint8)], minlength=len(MARKS) + 2)[:len(MARKS) + 1]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (square root of the base-2 divergence) of two count vectors."""
    p, q = p / max(p.sum(), 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2
    return float(np.sqrt(max(d, 0.0)))


def repeat_words(words: list[list[bytes]], width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words inside a window of ``width`` words that the text has twice or more.

    Windows are named exactly by doubling: the name of a window of 2k words is
    the rank of the pair of names of its halves.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    flat = [w for ws in words for w in ws]
    if len(flat) < width:
        return out
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    d = 1
    while d < width:  # windows that cross texts are dropped below
        ids = np.unique(ids[:-d] * np.int64(len(flat) + 1) + ids[d:], return_inverse=True)[1]
        d *= 2
    n = len(ids)
    inside = np.flatnonzero(doc[:n] == doc[width - 1:])
    if not len(inside):
        return out
    _, inverse, counts = np.unique(doc[inside] * np.int64(n + 1) + ids[inside], return_inverse=True,
                                   return_counts=True)
    starts = inside[counts[inverse] > 1]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    covered = np.cumsum(cover[:-1]) > 0
    np.add.at(out, doc[covered], 1)
    return out


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen = Counter(data.split(b"\n"))
    return sum(n - 1 for line, n in seen.items() if n > 1 and line.split())


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = [t.split() for t in texts]  # bytes.split parts at exactly space and \x09-\x0D
    continuation = bytes(range(0x80, 0xC0))
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": np.array([len(b"".join(w).translate(None, continuation)) for w in words], np.int64),
        "n_symbols": np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeat_words(words),
    }


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                        n_common: int = 64) -> DataFrame:
    """``(lang, reference)``: per language the counts of character classes, then marks, and common words, as JSON.

    Counted over all documents: partial counts per task, then a grouped sum.
    The common words are the ``n_common`` most frequent (ties by word).
    """
    def count(batches):
        words: dict[object, Counter] = {}
        classes: dict[object, np.ndarray] = {}
        held = 0

        def flush():
            for lang, c in words.items():
                c.update({b" %d" % i: int(n) for i, n in enumerate(classes[lang])})  # words hold no blank
                rows = iter(c.items())
                while part := list(islice(rows, 20_000)):
                    word, n = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())],
                        names=["lang", "word", "n"])
            words.clear()
            classes.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), (t for part in text_slices(b.column(1)) for t in part)):
                c = words.setdefault(lang, Counter())
                before = len(c)
                c.update(t.translate(FOLD).split())
                held += len(c) - before
                classes[lang] = classes.get(lang, 0) + np.concatenate([class_counts(t), mark_counts(t)])
                if held > 150_000:  # partial sums: the task's memory stays bounded
                    yield from flush()
                    held = 0
        yield from flush()
        release_memory()

    counts = (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
              .mapInArrow(count, "lang string, word binary, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts = stored(counts)
    is_class = F.substring("word", 1, 1) == F.lit(b" ")  # words hold no blank
    top = (counts.filter(~is_class)
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
           .filter(F.col("rank") <= n_common))
    common = F.struct("rank", F.hex("word").alias("word"), "n")
    classes = F.struct(F.col("word").cast("string").cast("int").alias("class"), "n")
    parts = (top.select("lang", common.alias("common"))
             .unionByName(counts.filter(is_class).select("lang", classes.alias("classes")), allowMissingColumns=True)
             .unionByName(counts.filter(~is_class).select("lang", F.col("n").alias("words")), allowMissingColumns=True))
    # collect_list skips nulls, so each list holds its own kind; both are short
    references = parts.groupBy("lang").agg(F.sort_array(F.collect_list("common")).alias("common"),
                                           F.sort_array(F.collect_list("classes")).alias("classes"),
                                           F.sum("words").alias("words"))
    return references.select("lang", F.to_json(F.struct("classes", "common", "words")).alias("reference"))


def _parsed(reference: str) -> tuple[np.ndarray, np.ndarray, dict[bytes, int], np.ndarray]:
    r = json.loads(reference)
    classes = np.array([c["n"] for c in r["classes"]], float)
    common = r.get("common") or []
    counts = [c["n"] for c in common]
    rest = (r.get("words") or 0) - sum(counts)
    return classes[:N_CLASSES], classes[N_CLASSES:], {bytes.fromhex(c["word"]): i for i, c in enumerate(common)}, np.array([*counts, rest], float)


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, char_distance double, word_distance double, mark_distance double")


def quality_measures(text: Column, reference: Column, min_chars: int = 200, min_words: int = 50,
                     base_min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """Struct of the counts and distances for a text and its language's reference.

    A distance is null (and passes) where the text is under its minimum length.
    """
    def judge(texts: pa.Array, references: pa.Array) -> pa.Array:
        refs = references.dictionary_encode()
        known = [_parsed(r) for r in refs.dictionary.to_pylist()]
        which = refs.indices.to_pylist()
        out: list[dict] = []
        for part in text_slices(texts):
            counts = base_counts(part)
            for i, text in enumerate(part):
                row = {k: int(v[i]) for k, v in counts.items()}
                row["base_failed"] = (row["n_words"] < base_min_words
                                      or 100 * row["n_repeat_words"] > max_repeat_percent * row["n_words"])
                classes, marks, index, common = known[which[len(out)]]
                seen = class_counts(text)
                words = text.translate(FOLD).split()
                row["char_distance"] = js_distance(seen, classes) if seen.sum() >= min_chars else None
                row["mark_distance"] = js_distance(mark_counts(text), marks) if seen.sum() >= min_chars else None
                row["word_distance"] = None
                if len(words) >= min_words and index:
                    c = Counter(words)
                    have = np.array([c[w] for w in index], float)
                    row["word_distance"] = js_distance(np.append(have, len(words) - have.sum()), common)
                out.append(row)
        done = pa.array(out, ARROW_MEASURES)
        release_memory()
        return done

    judge.__annotations__ = {"texts": pa.Array, "references": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, MEASURES_DDL).asNondeterministic()(text, reference)


ARROW_MEASURES = pa.struct([pa.field(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t])
                            for n, t in (f.split(" ") for f in MEASURES.split(", "))])
MEASURES_DDL = "struct<" + ", ".join(f.replace(" ", ":") for f in MEASURES.split(", ")) + ">"


def with_verdict(docs: DataFrame, name: str, text_col: str = "text", lang_col: str = "lang",
                 columns: list[str] | None = None, max_char_distance: float = 0.30, max_word_distance: float = 0.50,
                 **limits) -> DataFrame:
    """``columns`` of ``docs`` (all if not given) with a struct column ``name`` of counts, distances and verdict."""
    columns = docs.columns if columns is None else columns
    lang, key = f"{name}_lang", f"{name}_key"
    # small written tables: their size is known, so the texts need not move to meet them
    refs = stored(language_references(docs, text_col, lang_col).toDF(lang, f"{name}_ref"))
    joined = docs.join(refs, F.col(lang_col).cast("string").eqNullSafe(F.col(lang)), "left")
    measured = stored(joined.select(*[docs[c] for c in columns], docs[lang_col].cast("string").alias(key),
                                    quality_measures(F.col(text_col).cast("string"), F.col(f"{name}_ref"), **limits)
                                    .alias(f"{name}_measures")))
    m = F.col(f"{name}_measures")
    fixed = {"char_distance": max_char_distance, "word_distance": max_word_distance, "mark_distance": 1.0}

    def fence(distance: str) -> Column:
        quartiles = F.percentile(F.round(m[distance], 4), [0.25, 0.75])
        spread = F.greatest(quartiles[1] - quartiles[0], F.lit(LEAST_SPREAD))
        found = F.least(quartiles[1] + FENCES[distance] * spread, F.lit(float(fixed[distance])))
        return F.struct(F.count(m[distance]).alias("n"), found.alias("fence")).alias(distance)

    def limit(own: Column, wider: Column) -> Column:
        return (F.coalesce(own["n"] * own["fence"], F.lit(0.0)) + PRIOR_DOCUMENTS * wider) / (own["n"] + PRIOR_DOCUMENTS)

    def limits_of(group: str, wider: Callable[[str], Column]) -> Column:
        return F.struct(*[limit(F.col(group)[d], wider(d)).alias(d) for d in fixed])

    corpus = stored(measured.agg(F.struct(*map(fence, fixed)).alias("all")).select(
        limits_of("all", lambda d: F.lit(float(fixed[d]))).alias("limits")))
    fences = stored(measured.groupBy(F.col(key).alias(lang)).agg(F.struct(*map(fence, fixed)).alias("own"))
                    .withColumn("corpus", corpus.scalar())
                    .select(lang, limits_of("own", lambda d: F.col("corpus")[d]).alias(f"{name}_max")))
    judged = measured.join(fences, F.col(key).eqNullSafe(F.col(lang)), "left")
    kept = ~m["base_failed"]
    for distance in fixed:
        kept &= F.coalesce(m[distance] <= F.col(f"{name}_max")[distance], F.lit(True))
    fields = [f.split(" ")[0] for f in MEASURES.split(", ")]
    return judged.select(*[measured[c] for c in columns],
                         F.struct(*[m[f].alias(f) for f in fields], kept.alias("kept")).alias(name))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  **limits) -> DataFrame:
    """One row per document: counts, distances and ``kept`` (see ``quality_measures`` and ``with_verdict`` for the limits)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return with_verdict(d, "verdict", columns=["doc_id"], **limits).select("doc_id", "verdict.*")


@small_batches
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, all columns as they came."""
    from lexiscope.llm.common import free_name

    v = free_name(docs, "quality_verdict")
    judged = with_verdict(docs, v)
    return judged.filter(F.col(f"{v}.kept")).select(*[judged[c] for c in docs.columns])
