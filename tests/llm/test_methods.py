"""Methods against plain Python, and inputs made to break them."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import common, decontaminate, katz, langid, mixing, simhash, toxicity


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_with_one_hash_are_two_words(spark):
    """A Thue-Morse word and its mirror: any polynomial hash modulo 2^64 takes them for one."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    mirror = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + mirror).encode(), np.uint8)
    h = common.span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] == h[1]
    ids = [i for i in range(200) if common.crc(i) % katz.FOLDS != katz.HELD_OUT][:2]
    held = next(i for i in range(200) if common.crc(i) % katz.FOLDS == katz.HELD_OUT)
    docs = spark.createDataFrame([(ids[0], word), (ids[1], f"{word} b"), (held, f"{word} {mirror}")], "doc_id long, text string")
    got = by_id(katz.query(docs))
    assert got[held]["n_known"] == 2 and got[held]["n_tokens"] == 3 and got[held]["train_tokens"] == 5
    v = 3  # the word, b, the end
    base = sum(math.log10((c + 1) / (5 + v + 1)) for c in (2, 0, 2))
    assert math.isclose(got[held]["base_score"], base, rel_tol=1e-12)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(300) if common.crc(i) % katz.FOLDS == katz.HELD_OUT][:3]
    docs = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    got = by_id(katz.query(docs))
    assert all((r["n_known"], r["train_tokens"], r["held_out"], r["score"]) == (0, 0, True, 0.0) for r in got.values())


@pytest.mark.parametrize("n", [1e3, 1e9, 1e12])
def test_samples_keep_their_share(n):
    """400 of n: the bound is where so many of n evenly spread hashes lie, at every size."""
    bound = common.hash_bound(400 / n)
    assert math.isclose((bound + (1 << 63)) / 2**64 * n, 400, rel_tol=1e-6)
    assert common.hash_bound(1.0) is None and common.hash_bound(7.0) is None


def test_samples_of_rows(spark):
    ids = spark.range(100_000).withColumnRenamed("id", "doc_id")
    n = ids.where(common.sampled("doc_id", 0.01)).count()
    assert 850 < n < 1150 and ids.where(common.sampled("doc_id", 1.0)).count() == 100_000


def test_frequent_labels_are_learnt_first(spark):
    rows = [(i, f"some words {i}", "en") for i in range(40)] + [(100 + i, f"autre texte {i}", "fr") for i in range(20)] + [(200 + i, "x", f"dirt{i}") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)
    assert model.languages == ["en", "fr"]


def test_language_of_whole_texts_by_brute_force(spark):
    """The least exact code length over all of a text decides, also where its beginning speaks for another language."""
    rows = [(i, ("la casa bella era piena di gente allegra " if i % 2 else "der hund und die katze schlafen im garten ") * 3, ("it", "de")[i % 2 == 0]) for i in range(40)]
    rows += [(90, "la casa bella " + "der hund und die katze " * 30, None), (91, "der hund " * 3 + "piena di gente " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = by_id(langid.query(docs))
    for i, t, _ in rows:
        bits = langid.code_lengths(model, [t.encode()])[0]
        assert got[i]["lang_pred"] == model.languages[int(bits.argmin())]
        assert math.isclose(got[i]["bits_per_byte"], bits.min() / len(t.encode()), rel_tol=1e-6)
    assert got[90]["lang_pred"] == "de" and got[91]["lang_pred"] == "it"


def test_toxicity_by_brute_force(spark):
    """The score from its definition: chains of beginnings word by word, all segments by recursion, the curve over the evidence."""
    rng = np.random.default_rng(3)
    text = lambda bad: " ".join(rng.permutation([*[f"wort{int(k)}" for k in rng.integers(0, 60, 30)], *["Übelwort"] * (2 * bad)]))
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(300)] + [(900, "never seen before"), (901, "... !"), (902, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)

    def odds(word: bytes) -> float:
        share = 0.5
        for n, stem in enumerate((*toxicity.STEMS, None)):
            if n and stem is not None and len(word) <= toxicity.STEMS[n - 1]:
                continue
            part = word if stem is None else word[:stem]
            (b,) = [t[0] for k, t in enumerate(toxicity.tokens(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))) if k == n]
            assert part
            one, zero = float(model.ones[b]), float(model.zeros[b])
            share = (one + toxicity.PRIOR * share) / (one + zero + toxicity.PRIOR)
        return math.log(share / (1 - share)) - toxicity.DRIFT

    def split(s: list[float], a: int, b: int) -> list[float]:
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        return [*split(s, a, best[2]), best[0], *split(s, best[3], b)] if best[0] > 0 else []

    got = by_id(toxicity.query(docs, labels))
    for r in docs.where("doc_id % 37 = 0 OR doc_id >= 900").collect():
        words = common.FOLD[np.frombuffer((r["text"] or "").encode(), np.uint8)].tobytes()
        words = [w for w in bytes(b if common.IS_ALNUM[b] else 32 for b in words).split()]
        if not words:
            want = model.prior
        else:
            found = split([odds(w) for w in words], 0, len(words))
            chance = math.log(model.constant * len(words))
            excess = [model.scale * x - chance for x in found]
            x = [1.0, max(-20.0, min(max(excess, default=-chance), 50.0)), math.log1p(sum(e for e in excess if e > 0)), math.log1p(sum(s for s in found if s > toxicity.FAIR)), math.log(len(words))]
            want = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(model.weights, x, strict=True))))))
        assert math.isclose(got[r["doc_id"]]["score"], want, rel_tol=1e-4, abs_tol=1e-6), r["doc_id"]


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "a few words") for i in range(20)], "doc_id long, text string")
    for rows in ([], [(i, 0) for i in range(20)], [(i, None) for i in range(20)]):
        got = toxicity.query(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == 20 and all(0 <= r["score"] <= 1 for r in got)


def test_benchmark_beside_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "one two three four", "r", 5, ["i"]), (2, None, "r", 6, []), (2, "one two three four", "q", 6, None)], "doc_id long, text string, ranges string, n_words int, items array<string>")
    tests = spark.createDataFrame([(1, "two three"), (1, "two three"), (2, "four"), (None, "x " * 900)], "item_id long, text string")
    for block_bytes in (1 << 20, 8):
        got = decontaminate.decontaminate(docs, tests, block_bytes=block_bytes)
        assert sorted(got.columns) == sorted(["doc_id", "text", "ranges", "n_words", "n_hit", "items", "contaminated"])
        assert sorted((r["doc_id"], r["ranges"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()) == [(1, "r", 4, 3, ("1", "2"), True), (2, "q", 4, 3, ("1", "2"), True), (2, "r", 0, 0, (), False)]


def test_blocks_of_a_benchmark(spark):
    """No block but a single row is larger than asked for, and every row is in one."""
    rows = [(i % 7, "w" * (1 + i * 37 % 90)) for i in range(100)] + [(None, "long" * 100)] * 3
    items = spark.createDataFrame(rows, "item string, text string")
    blocks = [[(r["item"], r["text"]) for r in b.collect()] for b in decontaminate._blocks(items, sum(len(t) for _, t in rows), 200)]
    assert all(len(b) == 1 or sum(len(t) for _, t in b) <= 200 for b in blocks)
    assert sorted(x for b in blocks for x in map(repr, b)) == sorted(repr((None if i is None else str(i), t)) for i, t in rows)


def test_slots_are_what_is_taken(spark):
    """Documents' words counted in the blocks of the slots, one by one."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ("a", "b", None, "b")[i % 4]) for i in range(400)] + [(5, "x y z", "a"), (5, "x y z", "a"), (None, "u v", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed, slots = mixing.mix_sources(docs, block=8)
    mixed = mixed.collect()
    drawn = defaultdict(Counter)
    for r in slots.collect():
        drawn[r["source"]][r["index"]] += 1
    for source in ("a", "b", None):
        own = [r for r in mixed if r["source"] == source]
        total = sum(r["size"] for r in own)
        words = sum(n * (min(total, (k + 1) * 8) - k * 8) for k, n in drawn[source].items())
        assert words == sum(r["taken"] for r in own) and abs(words - own[0]["target"]) <= 8
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own) and max(drawn[source].values()) <= 2


def test_shards_are_drawn_and_full(spark):
    slots, weights = np.array([5000, 900, 0, 2300, 7]), np.array([5.0, 1.0, 0.0, 2.2, 0.01])
    got = mixing.draw_counts(spark, slots, weights, 3, size=64).toPandas()
    shards = got.groupby("shard")["n"].sum()
    assert (shards.iloc[:-1] == 64).all() and shards.sum() == slots.sum() and len(shards) == -(-slots.sum() // 64)
    assert got.groupby("s")["n"].sum().to_dict() == {0: 5000, 1: 900, 3: 2300, 4: 7}
    # Like draws: the counts of the first source spread as a binomial's do.
    share = got[got["s"] == 0].set_index("shard")["n"].reindex(range(len(shards) - 1), fill_value=0)
    p = 5000 / slots.sum()
    assert abs(share.mean() - 64 * p) < 1.5 and 0.5 < share.var() / (64 * p * (1 - p)) < 2
    again = mixing.draw_counts(spark, slots, weights, 3, size=64).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, again.to_numpy()))
    numbered = mixing.draw_slots(mixing.draw_counts(spark, slots, weights, 3, size=64), [(str(k), int(n) * 8) for k, n in enumerate(slots)], 8, 3, int(slots.sum()))
    assert numbered.groupBy("s").agg(F.countDistinct("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("index").alias("c")).where("a <> b + 1 OR a <> c").isEmpty()


def test_surplus_slots_go_where_they_lack():
    rng = np.random.default_rng(0)
    for _ in range(50):
        wanted = rng.integers(0, 50, 6)
        drawn = rng.multinomial(wanted.sum(), (wanted + 1) / (wanted + 1).sum())
        after = drawn.copy()
        for giver, first, end, taker in mixing.transfers(drawn, wanted):
            after[giver] -= end - first
            after[taker] += end - first
        assert (after == wanted).all()


def test_crowded_keys_miss_nothing():
    """Many prints under one key: cut by parts, all links at four bits are kept together."""
    rng = np.random.default_rng(7)
    p = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in p], np.uint64)
    both = np.unique(np.concatenate([p, p ^ flips]))
    a, b = simhash.forest(*simhash.linked(np.zeros(len(both), np.uint64), both, np.ones(len(both), bool)))
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    top = lambda x: root.get(x, x)
    assert all(top(x) == top(y) for x, y in zip(p.tolist(), (p ^ flips).tolist(), strict=True))
    want = {int(x): {int(x)} for x in both}
    near = np.bitwise_count(both[:, None] ^ both[None, :]) <= 4
    assert all(top(int(both[i])) == top(int(both[j])) for i, j in zip(*np.nonzero(near), strict=True)) and len(want) == len(both)
