"""The near-dedup stage against exact Jaccard over all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tidelake.llm import simhash


def shingled(text: str) -> frozenset:
    w = text.lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def firsts(texts: dict[int, str], similarity: float = 0.8) -> set[int]:
    """The least id of each component of all pairs at the similarity or more."""
    sets, root = {i: shingled(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) / len(a | b) >= similarity:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if top(i) == i}


def edited(rng: random.Random, words: list[str], n: int) -> str:
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(3), []
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(250):  # pairs around the threshold
        base = fresh(rng.randrange(60, 400))
        out += [" ".join(base), edited(rng, base, max(1, round(len(base) * rng.uniform(0.01, 0.04))))]
    hot = fresh(300)
    out += [edited(rng, hot, rng.randrange(1, 9)) for _ in range(150)]  # a large group, whose members are alike to some of the others
    out += ["", " \n", "one two", "ONE  two", "one two three", " ".join(fresh(3000))]
    rng.shuffle(out)
    return dict(enumerate(out))


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3, "doc_id")
    return {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_copies_at_the_threshold_and_above_go(spark, texts):
    missed = kept_of(spark, texts) - firsts(texts)
    assert not missed


def test_documents_below_the_threshold_stay(spark, texts):
    lost = firsts(texts) - kept_of(spark, texts)
    assert not lost


def test_keys_and_sketches_at_the_threshold():
    assert simhash.keys_at(0.8) == 24 and 1 - (1 - 0.8**simhash.KEY_VALUES) ** 24 > 0.9999
    assert simhash.bits_at(0.8) > 0.1 * simhash.SKETCH


def test_large_groups_by_units(spark, monkeypatch):
    """Hundreds of texts just above and below the threshold under the same keys, in units of a few dozen: brute force says which stay."""
    monkeypatch.setattr(simhash, "UNIT", 40)
    rng = random.Random(8)
    hot = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {i: edited(rng, hot, rng.randrange(1, 7)) for i in range(240)} | {1000 + i: edited(rng, hot, 12) for i in range(40)}
    want = firsts(texts)
    assert 20 < len(want) < 200
    assert kept_of(spark, texts) == want


def test_spanning_links():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(45, 60)], rng.integers(0, 1 << 60, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(120)]
    alike = lambda x, y: (n := len(np.intersect1d(x, y))) / (len(x) + len(y) - n) >= 0.8
    x, y = simhash.spanning(sets, 0.8)
    assert all(alike(sets[i], sets[j]) for i, j in zip(x, y, strict=True)) and len(x) < len(sets)
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        root[top(i)] = top(j)
    assert all(top(i) == top(j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]))
