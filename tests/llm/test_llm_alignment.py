"""Pair bitmaps and alignment against a whole-text brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexiscope.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
random.seed(4)
ODD = ["a", "the of", "  ", "\n", "\n\n", " \n ", "x's", "!'s", "<|endoftext|>", "</s>", "日本語 テスト", "é", " ", "　", "ﬁ", "🙂",
       "12 345", "don't", "\t", "\x85", "  ", "Ünï", "<0x0A>", "#'s", "\x1c", "​", "...", "á"]
TEXTS = [None, "", " ", "a", "ein▁wort", "the the the cat", "\0b", "word " * 3000,
         *["".join(random.choice(ODD) + random.choice(["", " ", " "]) for _ in range(random.randint(1, 60))) for _ in range(250)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat", 1, "x"), (5, TEXTS[5], 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string").repartition(4)


def brute(rows):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = {chr(v): k for k, v in alignment.BYTE_LETTERS.items()}
    name_b = lambda p: bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    each, count = [], Counter()
    for i, t in rows:
        whole = (" " + (t or "")).encode()
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        na = [bytes(letters[c] for c in a.id_to_token(x)) for x in ia]
        nb = [name_b(b.id_to_piece(x)) for x in ib]
        if not t or b"".join(na) != whole or b"".join(nb) != whole:
            each.append((i, [], [], [], [], ""))
            continue
        ea, eb = np.cumsum([len(x) for x in na]).tolist(), np.cumsum([len(x) for x in nb]).tolist()
        links = [(x, y) for x, s, e in zip(ia, [0, *ea], ea) for y, p, q in zip(ib, [0, *eb], eb) if s < q and p < e]
        groups, cuts = [], sorted(set(ea) & set(eb))
        for lo, hi in zip([0, *cuts], cuts):
            groups.append(",".join(str(x) for x, e in zip(ia, ea) if lo < e <= hi) + "|" +
                          ",".join(str(x) for x, e in zip(ib, eb) if lo < e <= hi))
        count.update(set(links))
        each.append((i, ia, ib, groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter((i, len(ia), len(ib), len(g), len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), h)
                   for i, ia, ib, g, ls, h in each), count


def test_alignment_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(alignment, "NEW_UNITS", 7)
    got, counts = alignment.aligned_documents(docs)
    rows = [(r.doc_id, (r.text if r.text is None or len(r.text) < 5000 else r.text)) for r in docs.collect() if not r.text or len(r.text) < 5000]
    long = [(r.doc_id, "word " * 3000) for r in docs.collect() if r.text and len(r.text) >= 5000]
    want, pairs = brute(rows + long)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r["count"] for r in counts.collect()} == dict(pairs)
    assert alignment.aligned_documents(docs.limit(0))[0].count() == 0


def test_postings_round_trip():
    rng = np.random.default_rng(6)
    for docs, n in ((1, 1), (40, 900), (3000, 20000)):
        keys = np.unique(rng.integers(0, 60, n) ** 2 * docs + rng.integers(0, docs, n))
        pair, doc = (keys // docs) * 977 << 32, keys % docs
        times = rng.integers(1, 12, len(keys))
        post = alignment.Postings.unpacked(alignment.Postings.build(pair, doc, times, docs).packed(), docs)
        names, counts = np.unique(pair, return_counts=True)
        assert (post.pairs == names).all() and (post.document_counts() == counts).all()
        values = rng.integers(0, 1 << 40, len(names))
        want = np.zeros(docs, np.int64)
        np.add.at(want, doc, times * values[np.searchsorted(names, pair)])
        assert (post.returned(values) == want).all()
    empty = alignment.Postings.build(*[np.zeros(0, np.int64)] * 3, 5)
    assert alignment.Postings.unpacked(empty.packed(), 5).returned(np.zeros(0, np.int64)).tolist() == [0] * 5
