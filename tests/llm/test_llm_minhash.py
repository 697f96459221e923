"""SuperMinHash near-duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from lexiscope.llm import minhash
from lexiscope.llm.words import word_hashes

random.seed(5)


def prose(n):
    return " ".join(random.choice("abcdefgh") + random.choice(["er", "Ion", "über", "x"]) + str(random.randint(0, 40)) for _ in range(n))


def changed(text, every):
    words = text.split()
    for k in range(0, len(words), every):
        words[k] = "zz%d" % k
    return " ".join(words)


BASES = [prose(random.randint(30, 160)) for _ in range(14)]
TEXTS = [None, "", " \n\t", "one", "ONE", "one two three", "one  two\nthree", *BASES,
         *[changed(b, e) for b in BASES[:8] for e in (17, 19, 23, 40, 61, 90)],
         *[b.replace(" ", "\n").upper() for b in BASES[8:11]], BASES[12] + " " + BASES[13], prose(9000)]
TEXTS += [TEXTS[-1] + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, BASES[0], "x", 0), (None, "solo words in here", "x", 0),
                                                          (9, BASES[2], "x", 0), (9, BASES[2], "x", 0), (None, None, "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, kept int").repartition(5)


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
        sets.append({tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        head = min((x for x in least[find(i)] if x is not None), default=None)
        out[d, len(sets[i]), head, d == head] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"piece": 2, "hot_band": 3}])
def test_components_against_brute_force(docs, options):
    got = minhash.near_duplicates(docs, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_jaccard_and_do_not_depend_on_order():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [pool[:200], pool[50:250], pool[:3], pool[:200][::-1], pool[7:8]]
    owner = np.repeat(np.arange(5), [len(s) for s in sets])
    sig = minhash.superminhash(np.concatenate(sets), owner, 5, 128)
    assert (sig[0] == sig[3]).all() and (sig[0] == sig[1]).mean() == pytest.approx(150 / 250, abs=0.15)
    assert sorted((sig[4] >> np.uint64(32)).tolist()) == list(range(128))  # one element: a whole permutation
    alone = minhash.superminhash(pool[:200], np.zeros(200, np.int64), 1, 128)
    assert (alone[0] == sig[0]).all()


def test_superminhash_equals_its_definition_element_by_element():
    rng = np.random.default_rng(4)
    for n, places in ((1, 8), (5, 16), (60, 16)):
        elements = rng.integers(0, 1 << 63, n).astype(np.uint64)
        least = [2 ** 64 - 1] * places
        for e in elements:
            order = list(range(places))
            for step in range(places):
                z = int(minhash.mix(np.array([e]) ^ minhash.mix(np.array([step + 1], np.uint64)))[0])
                at = step + ((z >> 32) * (places - step) >> 32)
                order[step], order[at] = order[at], order[step]
                least[order[step]] = min(least[order[step]], step << 32 | z & 0xFFFFFFFF)
        assert minhash.superminhash(elements, np.zeros(n, np.int64), 1, places)[0].tolist() == least


def test_shape_and_word_hashes():
    bands, rows = minhash.tuned_bands()
    p = 0.8 ** rows
    assert 1 - (1 - p) ** bands - bands * p * (1 - p) ** (bands - 1) >= minhash.RECALL
    data = b"ab " + b"q" * 600_000 + b" ab " + b"q" * 300 + b" ba"
    starts, ends = np.array([0, 3, 600_004, 600_007, 600_308]), np.array([2, 600_003, 600_006, 600_307, 600_310])
    h = word_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_spanning_forest_joins_whatever_is_connected():
    rng = np.random.default_rng(8)
    m = rng.integers(0, 100, (30, 30))
    m = np.maximum(m, m.T)
    for least in (0, 60, 90, 97, 101):
        up = list(range(30))
        for edges in (spanned := minhash.spanning(m, least), [(i, j) for i in range(30) for j in range(i) if m[i, j] >= least]):
            groups = {i: {i} for i in range(30)}
            for a, b in edges:
                if groups[a] is not groups[b]:
                    groups[a] |= groups[b]
                    for x in groups[b]:
                        groups[x] = groups[a]
            up = [min(groups[i]) for i in range(30)] if edges is spanned else up
            assert [min(groups[i]) for i in range(30)] == up
        assert all(m[a, b] >= least for a, b in spanned) and len(spanned) == 30 - len(set(up))
