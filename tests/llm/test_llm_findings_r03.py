"""Memory of a shard whose open text is sorted, parts of it that meet in the merge, and words that a tokenizer keeps."""

import numpy as np
import pyarrow as pa

from lexiscope.llm import packing, suffix_dedup


def test_sorting_open_text_takes_little_memory_and_parts_meet_later(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, 6).tolist()) for _ in range(400)]
    text = b" ".join(words[i] for i in rng.integers(0, 400, 90_000))
    sizes = np.full(60, len(text) // 60)
    shard = suffix_dedup.Shard(0, list(range(60)), sizes, text[:sizes.sum()], 20)
    tracemalloc.start()
    base = tracemalloc.get_traced_memory()[0]
    suffix_dedup.first_of_equals(shard.bytes, np.ones(len(shard.bytes), bool), 20)
    assert (tracemalloc.get_traced_memory()[1] - base) / len(shard.bytes) < 50
    tracemalloc.stop()

    open_all = np.full(len(shard.hash), suffix_dedup.OPEN, np.uint8)

    def settled():
        return [r for b in suffix_dedup._settled(shard, open_all, 20) for r in b.to_pylist()]

    def covered(rows, kind):
        return {(r["doc"], p) for r in rows if r["kind"] == kind for p in range(r["start"], r["stop"] - 19)}

    whole = settled()
    monkeypatch.setattr(suffix_dedup, "OPEN_BYTES", 30_000)
    parts = settled()
    # what a part leaves open is what repeats in another part: the merge over all shards finds it
    merged = suffix_dedup.merge_windows(pa.Table.from_pylist([r for r in parts if r["kind"] == 1]), 20).to_pylist()
    found = covered(parts, 0) | {(r["doc"], p) for r in merged for p in range(r["start"], r["stop"] - 19)}
    assert covered(whole, 0) == found


def test_tokenizer_keeps_few_words_and_the_same_ids():
    tokenizer = packing.WordTokenizer(packing.word_bpe_path())
    texts = [b" ".join(b"%x%s" % (k, b"a" * (k % 3)) for k in range(i * 60_000, (i + 1) * 60_000)) for i in range(6)]
    first = [tokenizer.encode([t, b"over the words"]) for t in texts]
    assert len(tokenizer.words) <= 310_000  # what is over the bound goes before the next texts
    again = packing.WordTokenizer(packing.word_bpe_path()).encode([texts[5], b"over the words"])
    assert all((a == b).all() for a, b in zip(first[5], again))


def test_rounds_of_components_are_dealt_by_their_edges(spark):
    from lexiscope.llm.common import TASKS_PER_CORE
    from lexiscope.llm.simhash import components

    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    keys = {"spark.sql.shuffle.partitions": str(4 * most), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 7) for i in range(300)] + [(5, 5), (300, 293)], "a long, b long")
        found = components(edges)
        assert len([f for f in found.inputFiles()]) <= most  # not one file for every shuffle partition
        assert {(r.node, r.root) for r in found.collect()} == {(i, i % 7) for i in range(307)}
        sized = components(edges, rows=302)
        assert sorted(sized.collect()) == sorted(found.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_verified_pairs_keep_their_pieces_in_few_tasks(spark, monkeypatch):
    from lexiscope.llm import minhash

    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(10_000, 100, replace=False)).astype(np.uint64)
    own = {n: np.sort(np.concatenate([base[n:], np.arange(n, dtype=np.uint64) + 20_000 + 100 * n])) for n in range(40)}
    sets = spark.createDataFrame([(n, bytearray(v.tobytes())) for n, v in own.items()], "node long, shingles binary")
    pairs = [(x, y) for x in range(40) for y in range(x + 1, 40)]
    like = {(x, y) for x, y in pairs if 100 * len(np.intersect1d(own[x], own[y])) >= 80 * len(np.union1d(own[x], own[y]))}
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        found = minhash.verified(spark.createDataFrame(pairs, "x long, y long"), sets, 80, piece=4)
        assert {(r.a, r.b) for r in found.collect()} == like and like
        assert found.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
