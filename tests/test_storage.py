"""State by key: levels, buckets, small results on the driver; where checkpoints may go; streams that go on."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelake.operators.frame import ZFrame, rows_of
from tidelake.plans import graph, storage
from tidelake.plans.feedback import CreationContext
from tidelake.streaming.adapter import StreamCommits


class Owner:
    large = False


def change(spark, rows, schema="k int, v string"):
    return graph.written(rows_of(spark, rows, schema, None), Owner())


def held(df):
    out = Counter()
    for *row, w in map(tuple, df.select("k", "v", "w").collect()):
        out[tuple(row)] += w
    return {k: w for k, w in out.items() if w}


def test_state_adds_up_in_few_parts(spark):
    rng, want = random.Random(0), Counter()
    state = storage.State(rows_of(spark, [], "k int, v string").df, ["k"])
    for _ in range(25):
        rows = [(rng.choice([None, *range(9)]), rng.choice("ab"), rng.choice([-1, 1, 2])) for _ in range(6)]
        got = change(spark, rows)
        for k, v, w in rows:
            want[k, v] += w
        if got is not None:
            state.add(got)
    assert held(state.frame()) == {k: w for k, w in want.items() if w}
    assert len(state.parts) <= 2 + math.log2(25 * 6)


def test_large_parts_are_read_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(storage, "FEW", 50)
    monkeypatch.setattr(storage, "MANY", 500)
    monkeypatch.setattr(storage, "BUCKET_ROWS", 100)
    state = storage.State(rows_of(spark, [], "k int, v string").df, ["k"])
    state.add(change(spark, [(k % 300 if k else None, str(k), 1) for k in range(1200)]))
    assert state.parts[-1].buckets == 12 and state.parts[-1].change.local is None
    state.add(change(spark, [(7, "7", -1), (300, "x", 4)]))
    touched = change(spark, [(7, "", 1), (300, "", 1), (None, "", 1)])
    keys = graph.keys_of(touched, ["k"])
    near = state.at(keys)
    files = {r[0] for r in near.where("w = 1").select(F.input_file_name()).distinct().collect()} - {""}
    assert 1 <= len(files) <= 3  # of 12
    got = held(ZFrame(near).having(keys.df, ["k"], True).df)
    assert got == {(7, str(k)): 1 for k in (307, 607, 907)} | {(300, "x"): 4, (None, "0"): 1}
    longs = graph.keys_of(change(spark, [(7, "", 1), (1 << 40, "", 1)], "k long, v string"), ["k"])
    assert {k for k, _ in held(ZFrame(state.at(longs)).having(longs.df, ["k"], True).df)} == {7}
    assert sum(held(state.frame()).values()) == 1200 - 1 + 4


def test_a_graph_on_bucketed_state(spark, monkeypatch):
    """The same changes with states in buckets and with small ones give the same results."""
    results = []
    for few, many in ((10_000, 2_000_000), (5, 40)):
        monkeypatch.setattr(storage, "FEW", few)
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(storage, "MANY", many)
        monkeypatch.setattr(storage, "BUCKET_ROWS", 20)
        c = CreationContext(spark)
        (ia, a), (ib, b) = c.new_input("k int, v int"), c.new_input("k int, u int")
        outs = [r.into_output() for r in (a.join(b, "k"), a.antijoin(b, "k"), a.reduce("k", F.sum(F.col("v") * F.col("w")).alias("n")))]
        x, rng = c.begin(), random.Random(5)
        for n in (60, 3, 3):
            ia.send_all([(rng.randrange(30), rng.randrange(4), rng.choice([-1, 1, 2])) for _ in range(n)])
            ib.send_all([(rng.randrange(40), rng.randrange(3), rng.choice([-1, 1])) for _ in range(n)])
            x.commit()
            results.append([sorted(map(tuple, o.get(x).collect())) for o in outs])
    assert results[:3] == results[3:]


def test_parts_in_buckets_are_merged(spark, monkeypatch):
    """A part in folders is merged with one that isn't, and with one that has another number of folders."""
    monkeypatch.setattr(storage, "FEW", 5)
    monkeypatch.setattr(graph, "FEW", 5)
    monkeypatch.setattr(storage, "MANY", 40)
    monkeypatch.setattr(storage, "BUCKET_ROWS", 20)
    rows = lambda a, b, w: change(spark, [(k, str(k), w) for k in range(a, b)])
    state = storage.State(rows_of(spark, [], "k int, v string").df, ["k"])
    for step, parts in ((rows(0, 60, 1), 1), (rows(20, 50, -1), 1), (rows(0, 100, 1), 1)):
        state.add(step)
        assert len(state.parts) == parts and "__bucket" not in state.frame().columns
    assert held(state.frame()) == {(k, str(k)): 1 + (k < 20 or 50 <= k < 60) for k in range(100)}
    assert state.frame().count() == 100


def test_shortest_paths_on_bucketed_state(spark, monkeypatch):
    monkeypatch.setattr(storage, "FEW", 5)
    monkeypatch.setattr(graph, "FEW", 5)
    monkeypatch.setattr(storage, "MANY", 20)
    monkeypatch.setattr(storage, "BUCKET_ROWS", 10)
    c = CreationContext(spark)
    i, r = c.new_input("node long, dist long")
    e, links = c.new_input("src long, dst long, len long")
    best = r.group_min("node")
    step = best.map(F.col("node").alias("src"), "dist").join(links, "src")
    far = F.col("dist") + F.col("len")
    c.feed_ordered(step.map(far.alias("k"), F.col("dst").alias("node"), far.alias("dist")), i, "k")
    o, x = best.into_output(), c.begin()
    # From 0 to each of 1..40 at 1, from each to 41..80 at 1 and at 3: the second ones come when the nodes are there already.
    e.add_all([(0, n, 1) for n in range(1, 41)] + [(n, 40 + n, 1) for n in range(1, 41)] + [(n, 40 + n % 40 + 1, 2) for n in range(1, 41)])
    i.add(0, 0)
    x.commit()
    assert {tuple(r) for r in o.get(x).collect()} == {(0, 0, 1)} | {(n, 1, 1) for n in range(1, 41)} | {(40 + n, 2, 1) for n in range(1, 41)}


def test_long_values_stay_out_of_the_driver(spark):
    assert change(spark, [(1, "x" * (storage.ROW_BYTES + 1), 1)]).local is None
    assert change(spark, [(1, "x", 1), (1, "x", 2)]).local.num_rows == 1
    assert change(spark, [(1, "x", 1), (1, "x", -1)]) is None
    nested = change(spark, [(1, [1, None], 1), (1, [1, None], 1)], "k int, v array<int>")
    assert nested.rows == 1 and nested.df.first()["w"] == 2
    floats = change(spark, [(1, 0.0, 1), (1, -0.0, 1), (2, float("nan"), 1), (2, float("nan"), 1)], "k int, v double")
    assert floats.rows == 2


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.checkpointed(Frame())


def test_streams_that_go_on_are_refused(spark):
    c = CreationContext(spark)
    i, r = c.new_input("k int")
    o, x = r.into_output(), c.begin()
    batch = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(RuntimeError, match="batch 3"):
        StreamCommits(x, i)(batch, 3)
    commits = StreamCommits(x, i, last=2)
    for number in (3, 3, 4):
        commits(batch, number)
    assert [tuple(r) for r in o.get(x).collect()] == [(1, 2)]
