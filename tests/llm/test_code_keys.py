"""The near-dedup stage's keys: SimHash segments as words of the Golay code, against plain Python."""

from __future__ import annotations

import numpy as np

from tidelake.llm import simhash
from tidelake.llm.common import mix64


def plain_margins(hashes, words):
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64))
    rows = [b"".join(int(x).to_bytes(8, "little") for x in mix64(np.array([h]) ^ salts)) for h in hashes]
    return np.array([sum(2 * (r[b // 8] >> (7 - b % 8) & 1) - 1 for r in rows) for b in range(64 * words)])


def code():
    words = np.arange(1 << simhash.LENGTH, dtype=np.uint32)
    return words[simhash.syndromes(words) == 0]


def distances(segments):
    """Cost of each of the 4,096 codewords, by their data bits."""
    words = code()
    bits = (words[:, None] >> np.arange(simhash.LENGTH)) & 1
    costs = np.zeros((len(segments), len(words)), np.int64)
    for i, m in enumerate(segments):
        costs[i, words >> simhash.CHECKS] = (np.abs(m) * (bits != (m > 0))).sum(axis=1)
    return costs


def test_margins():
    rng = np.random.default_rng(1)
    for n in (1, 4, 255, 256, 600):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert np.array_equal(simhash.margins(hashes, 3), plain_margins(hashes, 3))


def test_codewords_are_the_nearest_by_margins():
    segments = np.random.default_rng(2).normal(0, 40, (200, simhash.LENGTH)).round().astype(np.int64)
    found, want = simhash.codewords(segments), distances(segments)
    assert all(f >> 12 == want[i, f & 4095] for i, row in enumerate(found.tolist()) for f in row if f >> 12 < simhash.NEVER)
    assert np.mean((found[:, 0] >> 12) == want.min(axis=1)) > 0.98


def test_stage_keys_are_golay_words_of_its_simhash(spark):
    """The stage's own sketches are SimHash bits, and each key is two codewords near to the segments."""
    rng = np.random.default_rng(4)
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for i, n in enumerate((8, 60, 300))}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    prints, _ = simhash.similar_sets(docs, "doc_id", "text", 5, 0.8)
    for r in prints.collect():
        own = simhash.shingles(texts[r[0]["id"]].encode(), 5)
        n = simhash.keys_at(0.8) * (2 if len(own) * 0.8 <= simhash.SHORT else 1)
        m = plain_margins(own, -(-(simhash.SKETCH + n * simhash.LENGTH) // 64))
        assert np.array_equal(np.array([r["p0"], r["p1"]]).view(np.uint64), np.packbits(m[: simhash.SKETCH] > 0).view(np.uint64))
        costs = distances(m[simhash.SKETCH : simhash.SKETCH + n * simhash.LENGTH].reshape(n, -1))
        ranks = costs.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
        keys = np.frombuffer(r["keys"], np.uint32)
        assert len(keys) == n // 2 * simhash.PAIRS and set((keys >> 24).tolist()) == set(range(n // 2))
        pair = keys >> 24
        near = np.concatenate([ranks[2 * pair, keys >> 12 & 4095], ranks[2 * pair + 1, keys & 4095]])
        assert np.median(near) < simhash.PAIRS


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(6)
    for common, a, b in ((4, 1, 0), (8, 1, 1), (20, 2, 3), (64, 8, 8), (120, 15, 15), (400, 50, 50)):
        draws = [rng.integers(0, 1 << 63, common + a + b, dtype=np.uint64) for _ in range(150)]
        x, p = simhash.code_keys([np.sort(d[: common + a]) for d in draws], 0.8)
        y, q = simhash.code_keys([np.sort(np.concatenate([d[:common], d[common + a :]])) for d in draws], 0.8)
        assert all(np.intersect1d(np.frombuffer(i, np.uint32), np.frombuffer(j, np.uint32)).size for i, j in zip(x, y, strict=True))
        assert (simhash.differing(p, q) <= simhash.bits_at(0.8)).all()


def test_close_ones():
    rng = np.random.default_rng(7)
    size = np.array([1, 2, 5, 12, 40, 300])
    first = np.cumsum(size) - size
    sketches = rng.integers(0, 1 << 63, (size.sum(), 2), dtype=np.uint64)
    for a, b in ((1, 2), (3, 5), (10, 19), (25, 59), (61, 359)):
        sketches[b] = sketches[a] ^ np.uint64(7)
    want = [sum(np.bitwise_count(sketches[i] ^ sketches[j]).sum() <= 42 for j in range(f, f + n)) > 1 for f, n in zip(first, size, strict=True) for i in range(f, f + n)]
    assert simhash.close_ones(sketches, first, size, 42).tolist() == want
