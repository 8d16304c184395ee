"""Repeats: hot seeds, copies, equal ids and long texts, against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidelake.llm import repeats


def plain(rows):
    """(id, text) -> (n_bytes, n_removed, kept) of each row: 50 bytes that also start in a row with a smaller id go."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def found(spark, rows, hot, monkeypatch, block=1 << 14):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.drop_repeats(docs, hot=hot).collect()
    return sorted((r["id"], r["n_bytes"], sum(s["end"] - s["first"] for s in r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)


@pytest.mark.parametrize("hot", [20, repeats.HOT])
def test_one_phrase_in_many_surroundings(spark, monkeypatch, hot):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase, licence = "this phrase has 28 bytes, ok", word(130)
    rows = [(i, word(rng.randrange(60)) + phrase + word(rng.randrange(60))) for i in range(1500)]
    rows += [(2000 + i, word(20) + licence + word(9)) for i in range(300)]
    rows += [(3000 + i, rows[rng.randrange(1500)][1][3:] + "é" * i) for i in range(200)]  # parts of others, the phrase within
    rows += [(i, t) for i, t in rows[:20]] + [(9000, None), (9001, ""), (-5, word(40) + licence)]
    rng.shuffle(rows)
    want = plain(rows)
    assert sum(x[2] > 0 for x in want) > 450
    assert found(spark, rows, hot, monkeypatch) == want


def test_hot_seeds_are_split_into_windows():
    layout = repeats.Layout.of(1 << 20, 20)
    rng = random.Random(2)
    texts = [("".join(rng.choice("abcdefgh") for _ in range(40)) + "this phrase has 28 bytes, ok" + "".join(rng.choice("abcdefgh") for _ in range(40))).encode() for _ in range(500)]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    p = repeats.pieces(data, sizes, layout.bits)
    hot = np.unique(p.seed)
    split = repeats.shared_runs(data, sizes, [repeats.bundle(repeats.pack_ints(hot, True), repeats.pack_ints(np.ones(len(hot), np.int64)))], layout)
    assert len(split.start) == int(p.count.sum()) and set(split.count.tolist()) == {1}
    # The index of a window is the same wherever it is, and one seed's windows are in many.
    assert len(np.unique(layout.index_of(split.seed))) == layout.parts * layout.indexes


def test_a_long_text_and_ids_that_are_no_numbers(spark, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklm nop") for _ in range(200_000))
    rows = [(1, long), (2, long[1000:1100] + "|" + long[150_000:190_000]), (3, long[::-1])]
    assert found(spark, rows, repeats.HOT, monkeypatch) == plain(rows)
    with pytest.raises(TypeError):
        repeats.drop_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
