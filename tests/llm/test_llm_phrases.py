"""Misra-Gries phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiscope.llm import phrases

random.seed(9)
VOCAB = "Aa b cc É über 日本 x y z1 the of".split(" ")


def text(n):
    return "".join(random.choice(VOCAB) + random.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(n))


def brute(rows, min_count, top):
    f, total = Counter(), Counter()
    for lang, t in rows:
        lang = lang or "und"
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", t):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for n in range(1, 5):
                f.update((lang, tuple(ws[i:i + n])) for i in range(len(ws) - n + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in cand.items():
        if any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 80 * a
               and any(q[1][i:i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in cand.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, le, r, total[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("mass,top", [(3_000_000, 2000), (300, 7)])
def test_phrases_against_brute_force(spark, mass, top):
    rows = [(None if i % 5 == 0 else random.choice(["en", "fr"]), text(random.randint(0, 60))) for i in range(160)]
    rows += [("en", None), (None, ""), ("de", "one two"), ("en", text(3000)), *[("fr", "alpha beta gamma delta. ")] * 12]
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "f long, lang string, text string, phrase string")
    counts, words = phrases.frequent_ngrams(docs.repartition(3), min_count=6, partition_mass=mass)
    got = phrases.collocations(counts, words, top=top)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6, top)
    assert phrases.collocations(*phrases.frequent_ngrams(docs.limit(0))).count() == 0


def test_every_frequent_item_survives_bounded_summaries():
    rng = np.random.default_rng(2)
    stream = np.concatenate([rng.integers(0, 1 << 40, 4000), np.repeat(rng.integers(0, 1 << 40, 9), 30),
                             np.repeat(rng.integers(0, 1 << 40, 300), 7)]).astype(np.uint64)
    rng.shuffle(stream)
    blobs = []
    for part in np.array_split(stream, 11):
        h, c = np.unique(part, return_counts=True)
        blobs.append(phrases.deflate(np.diff(h, prepend=np.uint64(0)), c.astype(np.uint64)))
    values, counts = np.unique(stream, return_counts=True)
    for entries in (1, 700, 10 ** 6):
        found = phrases.frequent(blobs, 30, entries)
        assert set(values[counts >= 30].tolist()) <= set(found.tolist())
        assert len(found) <= len(stream) // 30 + 1
    h, c, cut = phrases.misra_gries([(np.arange(5, dtype=np.uint64), np.array([9, 2, 5, 2, 1], np.uint64))], 2)
    assert (h.tolist(), c.tolist(), cut) == ([0, 2], [7, 3], 2)
