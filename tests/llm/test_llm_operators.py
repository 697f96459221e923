"""The corpus operators against brute force, on small rows with every awkward case."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiscope.llm import (
    chat, decontaminate, langid, licenses, packing, paragraphs, quality, simhash, suffix_dedup, warc,
)

random.seed(11)
WORDS = "the of and in tion er ou est und der das él ñu über x1 Über THE".split()


def sentence(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "", ".", ","]) for _ in range(n))


LONG = sentence(6000)
BASE = [sentence(random.randint(20, 90)) for _ in range(12)]
TEXTS = [None, "", "  \n ", "a", *BASE, BASE[0], BASE[1] + " more", BASE[2] + "\n" + BASE[3], "a" * 400, LONG, LONG + " z",
         "# * $ % \n" + BASE[4] + "\n" + BASE[4]]


@pytest.fixture(scope="module")
def docs(spark):
    """Null text, null id, a repeated row and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, 0, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, BASE[5], "en", 0, "x"), rows[6], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, shard_id string").repartition(5)


def as_rows(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def key(i):
    return (i is None, i or 0)


# ---- suffix arrays -----------------------------------------------------------------

def test_suffix_array_and_prefixes():
    for alphabet, n in ((1, 300), (2, 900), (200, 500)):
        data = np.random.default_rng(n).integers(0, alphabet, n).astype(np.uint8)
        raw, order = data.tobytes(), suffix_dedup.suffix_array(data)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))
        prefix = suffix_dedup.kasai(data, order, 50, lanes=9)
        for r in range(1, n):
            a, b = raw[order[r]:], raw[order[r - 1]:]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert prefix[r] == min(same, 50)


@pytest.mark.parametrize("hot_bytes", [1 << 22, 1])
def test_repeats_against_brute_force(docs, hot_bytes):
    length = 30
    got = suffix_dedup.remove_repeats(docs, length=length, hot_bytes=hot_bytes).select("rest.*", "n_bytes", "spans", "kept")
    rows = got.collect()
    assert len(rows) == docs.count() and {"kept", "shard_id", "lang"} <= set(got.columns)
    seen, want = set(), Counter()
    for i, t in sorted(as_rows(docs), key=lambda r: key(r[0])):
        cover = bytearray(len(t))
        for k in range(len(t) - length + 1):
            w = t[k:k + length]
            if w in seen:
                cover[k:k + length] = b"\1" * length
            seen.add(w)
        want[i, sum(cover), bytes(b for b, c in zip(t, cover) if not c)] += 1
    have = Counter((r[0], sum(s.stop - s.start for s in r.spans), bytes(r[-1])) for r in rows)
    assert have == want


def test_repeats_of_an_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# ---- quality --------------------------------------------------------------------------

def brute_quality(text):
    words = text.split()
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(8)}
    seen, duplicates = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            duplicates += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in b"#*$%&|<>"), duplicates,
            len(inside))


def test_quality_counts_and_verdict(docs):
    rows = quality.quality_rules(docs).collect()
    want = Counter((i, *brute_quality(t)) for i, t in as_rows(docs))
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert (r.word_distance is None) or 0 <= r.word_distance <= 1
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_divergence_rejects_another_alphabet_but_guards_short_texts(spark):
    rows = [(i, sentence(80), "en") for i in range(40)] + [(90, "%%% $$$ ### " * 40, "en"), (91, "## $$", "en")]
    rows += [(92, " ".join("%s!!" % w.upper() for w in sentence(90).split()), "en")]
    got = {r.doc_id: r for r in quality.quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"), base_min_words=1,
        max_repeat_percent=100).collect()}
    assert all(got[i].kept for i in range(40))
    assert not got[90].kept and not got[92].kept
    assert got[91].char_distance is None and got[91].kept
    assert quality.js_distance(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1)


def test_limits_follow_the_distances_of_the_language(spark):
    clean = [(i, sentence(random.randint(60, 200)), "en", True) for i in range(400)]
    menus = [(1000 + i, " | ".join(sentence(150).split()), "en", False) for i in range(20)]
    rows = clean + menus
    got = {r.doc_id: r for r in quality.quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean"), max_repeat_percent=100).collect()}
    assert not any(got[i].kept for i, *_ in menus)
    assert all(got[i].char_distance <= 0.30 and got[i].word_distance <= 0.50 for i, *_ in menus)  # the fixed limits pass them
    assert sum(got[i].kept for i, *_ in clean) >= 396


def test_limits_and_verdicts_against_brute_force(spark):
    """Distances, quartiles and verdicts recomputed; languages of 1, 30 and 300 documents follow one rule."""
    texts = [("und", None)] + [("en", sentence(random.randint(60, 160))) for _ in range(300)]
    texts += [("de", sentence(random.randint(60, 160)).upper()) for _ in range(30)] + [(None, sentence(90) + " !?" * 40)]
    texts += [("en", " | ".join(sentence(120).split())) for _ in range(9)] + [("de", "short")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    data = {i: (t or "").encode() for i, t, _ in rows}
    folded = {i: re.findall(rb"[a-z0-9\x80-\xff]+", b.lower()) for i, b in data.items()}
    distances = {}
    for lang in {x for *_, x in rows}:
        own = [i for i, _, x in rows if x == lang]
        counts = Counter(w for i in own for w in folded[i])
        common = sorted(counts, key=lambda w: (-counts[w], w))[:64]
        base = np.array([*[counts[w] for w in common], sum(counts.values()) - sum(counts[w] for w in common)], float)
        chars, marks = (sum(f(data[i]) for i in own) for f in (quality.class_counts, quality.mark_counts))
        for i in own:
            have = [folded[i].count(w) for w in common]
            long = quality.class_counts(data[i]).sum() >= 200
            distances[i] = {
                "char_distance": quality.js_distance(quality.class_counts(data[i]), chars) if long else None,
                "mark_distance": quality.js_distance(quality.mark_counts(data[i]), marks) if long else None,
                "word_distance": quality.js_distance(np.array([*have, len(folded[i]) - sum(have)], float), base)
                if len(folded[i]) >= 50 and common else None}
    fixed = {"char_distance": 0.30, "word_distance": 0.50, "mark_distance": 1.0}

    def limit(d, ids, wider):
        x = [round(distances[i][d], 4) for i in ids if distances[i][d] is not None]
        if not x:
            return wider
        a, b = np.percentile(x, [25, 75])
        fence = min(b + quality.FENCES[d] * max(b - a, quality.LEAST_SPREAD), fixed[d])
        return (len(x) * fence + quality.PRIOR_DOCUMENTS * wider) / (len(x) + quality.PRIOR_DOCUMENTS)

    for i, _, lang in rows:
        kept = not got[i].base_failed
        for d in fixed:
            assert (got[i][d] is None) == (distances[i][d] is None)
            if distances[i][d] is not None:
                assert got[i][d] == pytest.approx(distances[i][d], abs=1e-12)
                most = limit(d, [j for j, _, x in rows if x == lang], limit(d, list(distances), fixed[d]))
                assert abs(most - distances[i][d]) > 1e-9
                kept &= distances[i][d] <= most
        assert got[i].kept == kept
    assert not any(got[i].kept for i, t, _ in rows if t and " | " in t)


# ---- SimHash ------------------------------------------------------------------------

def test_simhash_against_all_pairs(docs):
    got = simhash.simhash_near_duplicates(docs).collect()
    rows = as_rows(docs)
    prints = []
    for _, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    up = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    up[a] = up[b] = min(up[a], up[b])
    least = {}
    for (i, _), u in zip(rows, up):
        least[u] = min(least.get(u, i), i, key=key)
    assert Counter(map(tuple, got)) == Counter((i, f"{p:016x}", least[u]) for (i, _), p, u in zip(rows, prints, up))
    assert simhash.simhash_near_duplicates(docs.limit(0)).count() == 0


def test_tiles_find_every_link(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 62, 40)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.integers(0, 62, rng.integers(0, 5))) for b in base for _ in range(6)}
    fps = sorted(fps)
    forest = simhash.Forest()
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                forest.join(a, b)
    for rows in (2048, 2):
        edges = simhash.tile_links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile_rows=rows)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        assert {f: roots.get(f, f) for f in fps} == {f: forest.find(f) for f in fps}


# ---- decontamination ------------------------------------------------------------------

def test_decontamination_against_brute_force(spark, docs):
    items = [("b1", BASE[0]), ("b2", "x1 over"), ("b3", None), ("b1", BASE[0]), (None, BASE[1]), ("b5", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    fold = lambda t: t.translate(decontaminate.FOLD).split()
    want = Counter()
    for i, t in as_rows(docs):
        w, hit, found = fold(t), set(), set()
        for item, text in items:
            v = fold((text or "").encode())
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[k:k + n]:
                        hit |= set(range(p, p + n))
                        found |= {item} - {None}
        want[i, len(w), len(hit), ",".join(sorted(found))] += 1
    for block in (1 << 25, 200):
        got = decontaminate.benchmark_hits(docs, bench, block_bytes=block)
        assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(sorted(r["items"]))) for r in got.collect()) == want
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0


# ---- packing ----------------------------------------------------------------------------

def test_packing_is_gapless_and_tight():
    rng = np.random.default_rng(2)
    for capacity, n in ((7, 40), (2048, 3000), (10, 0)):
        lengths = np.minimum(rng.exponential(capacity / 4, n).astype(int) + 1, capacity)
        of, at = packing.best_two_fit(lengths, capacity)
        ends = Counter()
        for b, a, size in sorted(zip(of.tolist(), at.tolist(), lengths.tolist())):
            assert a == ends[b]
            ends[b] += size
        assert all(v <= capacity for v in ends.values())
        assert len(ends) <= -(-int(lengths.sum()) // capacity) * 1.06 + 1


def test_pieces_are_the_tokenizers_ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    extra = ["Été  <|endoftext|>x don't <|ENDOFTEXT|>", "é  　 ǅ İ", "a.b,c! 12 ½", "x" * 5000]
    spark = docs.sparkSession
    given = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + k, t) for k, t in enumerate(extra)],
                                                                      "doc_id long, text string"))
    rows = packing.token_pieces(given, max_tokens=64).collect()
    have = Counter()
    for i, t in [(r.doc_id, r.text or "") for r in given.distinct().collect()]:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 64):
            have[i, k // 64, k, min(64, len(ids) - k), ids[k:k + 64].tobytes()] = 1
    assert {tuple(r)[:4] + (bytes(r.ids),) for r in rows} == set(have)
    packed = packing.packed_documents(given).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert packing.packed_documents(given.limit(0)).count() == 0


# ---- chat --------------------------------------------------------------------------------

def test_chat_round_trip():
    pieces = ["[TURN]", "[TURN1]", "[SAYS]", "[DONE]", "\\", "|", "a", "</s>", "[INST]", "\n", "é", "]"]
    for _ in range(3000):
        role, text = ("".join(random.choice(pieces) for _ in range(random.randint(0, n))) for n in (3, 7))
        out = chat.round_trip(role, text)
        assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2
    with pytest.raises(ValueError):
        chat.parse("[TURN]user[SAYS]open")


def test_chat_reads_back_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"),
            (None, 3, "assistant", "[DONE]"), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb</s>\nassistant\n\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, sha("b</s>"))
    assert got[2].turns_sha256 == sha("\nx\n\nx\n") and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("[DONE]")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---- WARC ---------------------------------------------------------------------------------

def test_loser_tree_merges():
    for _ in range(200):
        runs = [sorted((random.randint(0, 30),) for _ in range(random.randint(0, 6))) for _ in range(random.randint(0, 9))]
        assert list(warc.loser_tree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmpdir_path):
    rows = [(1, None, None), (2, "http://a/\r\nx", ""), (None, "u", "WARC/1.1\r\n\r\n"), (5, "http://www.B.org/é?q=1", "WARC/1.1\r\n\r\n"),
            (5, "http://b.org/", "WARC/1.1\r\n\r\n"), (6, "http://b.org/", BASE[0]), (9, "http://b.org/", "é" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit(1))
    index = warc.capture_index(df, tmpdir_path + "/w", volume_bytes=2000)
    got = index.collect()
    order = [(r.url_key, r.date, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    for r in got:
        body = {1: "", 2: "", None: "WARC/1.1\r\n\r\n", 5: "WARC/1.1\r\n\r\n", 6: BASE[0], 9: "é" * 3000}[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.base32_sha1(body))
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (1, "response", None), (2, "revisit", 1), (5, "response", None), (None, "revisit", 5), (6, "response", None),
        (9, "response", None)}
    assert all(r.record_type == "response" for r in warc.capture_index(df, tmpdir_path + "/v", min_payload=10 ** 6).collect())
    assert warc.capture_index(df.limit(0), tmpdir_path + "/e").count() == 0


# ---- paragraphs -----------------------------------------------------------------------------

def brute_paragraphs(rows, least, reach=paragraphs.REACH):
    """(row, start, stop, is line, shingles) of every paragraph."""
    for n, (_, t) in enumerate(rows):
        words = [(m.start(), m.end()) for m in re.finditer(
            rb"(?:[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xff][\x80-\xbf]{3}|[0-9A-Za-z\x80-\xdf]+)", t)]
        low = [t[a:z].translate(paragraphs.FOLD) for a, z in words]
        at = 0
        for x in t.split(b"\n"):
            own = [w for w, (a, _) in zip(low, words) if at <= a < at + len(x)]
            if len(own) >= least:
                yield n, at, min(at + len(x) + 1, len(t)), True, tuple(tuple(own[k:k + 5]) for k in range(len(own) - 4))
            at += len(x) + 1
        data = np.frombuffer(t.translate(paragraphs.FOLD), np.uint8)
        h = paragraphs.word_hashes(data, *(np.array(c, np.int64) for c in zip(*words))) if words else []
        v = [int(paragraphs.chained(h[k:k + 2], 2)[0]) for k in range(len(h) - 1)] + [2 ** 64 - 1]
        anchor = [k for k in range(len(words)) if all(v[k] < x for x in v[max(0, k - reach):k])
                  and all(v[k] <= x for x in v[k + 1:k + 1 + reach]) and v[k] < 2 ** 64 - 1]
        for k in anchor:
            to = next((j for j in anchor if j >= k + least), None)
            if to is not None:
                own = low[k:to]
                yield n, words[k][0], words[to][0], False, tuple(tuple(own[j:j + 5]) for j in range(len(own) - 4))


@pytest.mark.parametrize("least,threshold", [(24, 0.8), (5, 0.5)])
def test_paragraphs_against_brute_force(spark, docs, least, threshold):
    line, passage = sentence(60), " ".join("w%d" % random.randint(0, 900) for _ in range(70))
    wide = "".join(chr(0x4E00 + random.randint(0, 900)) for _ in range(60))
    near = " ".join(line.split()[:-1] + ["changed"])
    extra = [(700, line), (701, "keep this one line here\n" + near), (702, "a b\na b"), (703, line + "\n" + line),
             (704, "x y z " + passage + " and more"), (705, "other\n" + passage.replace(" ", "\n", 30) + "\nend"),
             (706, wide), (707, "\u3002" + wide + "x")]
    given = docs.select("doc_id", "text").filter("length(text) < 3000 or text is null").union(
        spark.createDataFrame(extra, "doc_id long, text string"))
    done = paragraphs.remove_paragraphs(given, min_jaccard=threshold, least_words=least).select("rest.doc_id", "spans").collect()
    rows = sorted(as_rows(given), key=lambda r: key(r[0]))
    paras = sorted(brute_paragraphs(rows, least), key=lambda p: p[:2])
    up = list(range(len(paras)))
    sets = [set(p[4]) for p in paras]
    links = [(a, b) for a in range(len(paras)) for b in range(a) if paras[a][4] and Counter(paras[a][4]) == Counter(paras[b][4])
             or paras[a][3] and paras[b][3] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    before = None
    while before != up:
        before = list(up)
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    cut = [set() for _ in rows]
    for a, (n, x, z, _, _) in enumerate(paras):
        if (n, x) != paras[up[a]][:2]:
            cut[n].update(range(x, z))
    want = Counter((i, len(cut[n])) for n, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, sum(s.stop - s.start for s in r.spans)) for r in done) == want
    gone = {r.doc_id: sum(s.stop - s.start for s in r.spans) for r in done}
    assert gone[701] and gone[703] and gone[705] >= len(passage) / 2 and gone[707] >= len(wide) * 1.5
    assert paragraphs.remove_paragraphs(given.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tuned_bands(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


# ---- language ----------------------------------------------------------------------------------

def test_language_held_out_accuracy_and_fusion(spark):
    voice = {"en": "the and of to that with this there", "de": "und der die das nicht mit über ein",
             "es": "que los una por para más según año"}
    say = lambda lang, n: " ".join(random.choice(voice[lang].split()) for _ in range(n))
    labelled = [(k, say(lang, 40), lang) for k, lang in enumerate(list(voice) * 30)]
    labelled += [(None, "x", "en"), (999, None, "de"), (1000, "y", None)]
    model = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    pages, truth = [], {}
    for k in range(90):
        lang = list(voice)[k % 3]
        truth[k] = lang
        pages.append((k, f"http://{lang}.site.org/{k}", f"<html lang='{lang}'><script>und der</script><p>{say(lang, 12)}</p>"))
    pages += [(200, "http://de.site.org/x", "<p></p>"), (201, None, None), (202, "::bad", "<html lang=es>"),
              (200, "http://de.site.org/x", "<p></p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    rows = langid.identify_languages(df, model).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert sum(got[k].lang == truth[k] for k in truth) >= 88
    assert got[200].lang == "de" and got[202].lang == "es"  # no text: the host's prior and the declaration decide
    assert langid.identify_languages(df.limit(0), model).count() == 0


# ---- licences ----------------------------------------------------------------------------------

def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Released under the MIT License."), (2, BASE[0] + "\nLicensed under CC BY-NC 4.0.\n" + BASE[1]), (3, None),
            (4, "Copyright 2020 someone\n\n" + mit), (5, sentence(300)), (6, ""), (7, mit.replace("Software", "Program", 1)),
            (1, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = licenses.license_scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].license for k in range(1, 8)] == ["MIT", "CC-BY-NC-4.0", None, "MIT", None, None, "MIT"]
    assert by[1].dice == 1.0 and by[7].dice < 1
    matcher = licenses.Matcher(licenses.templates())
    for text in [mit, *BASE]:  # pruning loses nothing
        words = text.encode().translate(licenses.FOLD).split()
        grams = set(zip(words, words[1:]))
        every = [2 * len(grams & g) / (len(grams) + len(g)) for g in
                 (set(zip(v, v[1:])) for v in (t.encode().translate(licenses.FOLD).split() for _, t in licenses.templates()))]
        best = matcher.best(words)
        assert (best[0] if best else 0) == (max(every) if max(every) >= 0.8 else 0)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_complete_licences_alone_and_inside_longer_texts(spark):
    full = {p.stem: p.read_text() for p in licenses.FULL_TEXTS.glob("*.txt")}
    assert len(full) == 13
    rows = [(name, text) for name, text in full.items()]
    rows += [(name, "# Readme\n\n" + sentence(900) + "\n\n## License\n\n" + text + "\n\n" + sentence(900))
             for name, text in full.items()]
    commented = "\n".join(" * " + x for x in full["MIT"].split("\n"))
    rows += [("MIT", "/*\n" + commented + "\n */\n" + "int x = 1;\n" * 3 + sentence(700)),
             ("MIT", sentence(60) + " It is released under the MIT License. " + sentence(60)),
             ("AGPL-3.0", sentence(90) + "\n" + licenses.GNU_HEADER.format(
                 what="program", stop=":", name="Affero General Public License", version="3") + "\n" + sentence(90))]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.license) for r in got] == [(name, name) for name, _ in rows]
    assert all(r.licenses == [r.doc_id] for r in got if r.doc_id in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"))


# ---- long and hostile texts ----------------------------------------------------------------

@pytest.mark.parametrize("piece", ["\\", "\\[", "[TURN", "\\\\[DONE]x"])
def test_chat_takes_long_runs_in_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    out = chat.round_trip("user", text)
    assert chat.parse(out)[0][:2] == ("user", text)
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("piece", ["<article>", "<script ", "<script>", "<!-- ", "<nav>", "<html ", "<html lang", "</article>", "<"])
def test_pages_with_unclosed_tags_take_linear_time(piece):
    html = "words before " + piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    seen, _ = langid.visible_text(html)
    langid.declared_language(html)
    assert seen.startswith("words before") and time.perf_counter() - start < 5


def test_visible_text_is_whole_but_for_hidden_elements():
    html = ("<html lang=DE><nav>menu</nav><p>one &amp; <b>two</b></p><!-- no <p>x</p> --><SCRIPT>if (a < b) {}</SCRIPT>"
            "<article>three <div class='ad'>four</div></article> 5 < 6 <style>p {}</style>seven<footer>x")
    seen, inside = langid.visible_text(html)
    assert seen.split() == "one & two three four 5 < 6 seven x".split() or seen.split()[:5] == "one & two three four".split()
    assert inside == "three four" and langid.declared_language(html) == "de"


def test_languages_without_labelled_texts(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x", "<p>hallo</p>"), (2, None, None)], "page_id long, url string, html string")
    for labelled in ([], [(1, "text", None)]):
        model = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
        got = {r.page_id: r for r in langid.identify_languages(pages, model).collect()}
        assert got[1].host == "a.de" and got[1].lang is None and got[2].probability is None


def test_posteriors_against_brute_force(spark):
    texts = [(i, sentence(40), "en") for i in range(12)] + [(20 + i, "ä ö " + sentence(30).replace("the", "dér"), "de") for i in range(12)]
    model = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    given = [(i, random.choice(["http://a.x.de/1", "http://b.x.de/2", "http://c.org", "bad", None]),
              f"<html lang={random.choice(['en', 'de', 'fr'])}><p>{t}</p>" if i % 4 else t) for i, t, _ in texts]
    given += [(100, None, None), (101, "http://a.x.de/9", "")]
    got = {r.page_id: r for r in langid.identify_languages(
        spark.createDataFrame(given, "page_id long, url string, html string"), model).collect()}
    facts = [(i, *langid.address_parts(u), langid.declared_language(h or ""),
              np.exp(model.log_posterior(*(x.encode() for x in langid.visible_text(h or ""))))) for i, u, h in given]
    mass = sum(f[5] for f in facts)
    overall = (mass + 1) / (mass.sum() + 2)
    s, total = langid.SMOOTHING, mass.sum() + 2

    def sums(col, value):
        return sum((f[5] for f in facts if f[col] == value), np.zeros(2))

    for i, host, domain, suffix, declared, p in facts:
        def prior(col, value, base):
            rest = np.maximum(sums(col, value) - p, 0)
            return (rest + s * base) / (rest.sum() + s) if value is not None else overall

        def likelihood(col, value):
            own = sums(col, value)
            return np.log((own + s * own.sum() / total) / (mass + s)) if value is not None else 0

        score = np.log(p) + np.log(prior(1, host, prior(2, domain, overall))) + likelihood(4, declared) + likelihood(3, suffix)
        want = np.exp(score - np.logaddexp(*score))
        assert got[i].probability == pytest.approx(want.max(), abs=2e-6)
        if abs(want[0] - want[1]) > 1e-6:
            assert got[i].lang == model.languages[int(want.argmax())]
