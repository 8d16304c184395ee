"""Programs over several commits, and changes against snapshots."""

from __future__ import annotations

import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelake.operators.frame import ZFrame, rows_of
from tidelake.plans.feedback import CreationContext, OrderedFeed
from tidelake.plans.games import fingers
from tidelake.plans.graph import ContextMismatch


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bag_union_and_visibility(spark):
    c = CreationContext(spark)
    i, r = c.new_input("c string")
    o = r.concat(r).into_output()
    heard = []
    o.add_listener(lambda: heard.append(1))
    x = c.begin()
    i.add_all([("a",), ("b",), ("a",), ("b",)])
    i.update(("b",), -1)
    assert rows(o.get(x)) == []
    x.commit()
    assert rows(o.get(x)) == [("a", 4), ("b", 2)] and heard
    with pytest.raises(RuntimeError):
        r.distinct()


def test_two_commits(spark):
    c = CreationContext(spark)
    i1, r1 = c.new_input("c string, n long")
    i2, r2 = c.new_input("c string, s string")
    bar = r1.join(r2, "c").map("c", (F.col("n") + F.octet_length("s")).alias("n"))
    baz = r2.map(F.coalesce(F.nullif(F.substring("s", 1, 1), F.lit("")), F.lit("x")).alias("c"), F.octet_length("s").cast("long").alias("n"))
    o, x = bar.concat(baz).distinct().into_output(), c.begin()
    i1.add_all([("a", 5), ("b", 6)])
    i2.add_all([("b", "Hello"), ("b", "world")])
    x.commit()
    assert rows(o.get(x)) == [("H", 5, 1), ("b", 11, 1), ("w", 5, 1)]
    i1.remove("b", 6)
    i2.add("a", "Goodbye")
    x.commit()
    assert rows(o.get(x)) == [("G", 7, 1), ("H", 5, 1), ("a", 12, 1), ("w", 5, 1)]


def test_ordered_feedback_with_retraction(spark):
    c = CreationContext(spark)
    i, r = c.new_input("u int, i long")
    m = r.group_min("u")
    c.feed_ordered(m.map(F.col("i").alias("k"), "u", (F.col("i") + 1).alias("i")), i, "k")
    o, x = m.into_output(), c.begin()
    i.add(0, 0)
    x.commit(max_rounds=20)
    assert rows(o.get(x)) == [(0, 0, 1)]
    i.remove(0, 0)
    x.commit(max_rounds=20)
    assert rows(o.get(x)) == []


def test_shortest_path_with_early_stop(spark):
    c = CreationContext(spark)
    starts, start = c.new_input("node string")
    ends, end = c.new_input("node string")
    links, edge = c.new_input("src string, dst string, len long")
    dists, dist = c.new_input("node string, dist long")
    best = dist.group_min("node")
    c.feed(start.map("node", F.lit(0).cast("long").alias("dist")), dists)
    c.interrupt(best.semijoin(end, "node").into_output(), lambda df: df.first()["dist"])
    ahead = F.col("dist") + F.col("len")
    c.feed_ordered(best.map(F.col("node").alias("src"), "dist").join(edge, "src").map(ahead.alias("k"), F.col("dst").alias("node"), ahead.alias("dist")), dists, "k")
    x = c.begin()
    starts.add("A")
    ends.add("F")
    links.add_all([("A", "B", 1), ("A", "C", 2), ("A", "F", 7), ("B", "D", 2), ("C", "E", 3), ("D", "A", 1), ("D", "E", 1), ("E", "A", 1), ("E", "F", 1)])
    assert x.commit() == 5


def test_frames_roll_back(spark):
    c = CreationContext(spark)
    i, r = c.new_trackable_input("n int")
    plain, p = c.new_input("n int")
    o, op, x = r.into_output(), p.into_output(), c.begin()
    i.add(1)
    x.commit()

    def try_it(x):
        i.add(2)
        i.remove(1)
        plain.add(9)
        x.commit()
        return rows(o.get(x))

    assert x.in_frame(try_it) == [(2, 1)]
    x.commit()
    assert rows(o.get(x)) == [(1, 1)] and rows(op.get(x)) == [(9, 1)]


def test_first_occurrences_and_probe(spark):
    c = CreationContext(spark)
    i, r = c.new_input("k string, v int")
    o, probe = c.first_occurrences(r, "k").into_output(), r.group_max("k").probe()
    x = c.begin()
    i.add_all([("a", 1), ("a", 2), ("a", 2)])
    x.commit()
    i.add_all([("a", 3), ("b", 4)])
    i.remove("a", 1)
    x.commit()
    assert rows(o.get(x)) == [("a", 1, 1), ("a", 2, 2), ("b", 4, 1)]
    assert rows(probe.inspect(x)) == [("a", 3), ("b", 4)]


def test_contexts_do_not_mix_and_dumps(spark):
    c, d = CreationContext(spark, count_records=True), CreationContext(spark)
    (i, r), (_, s) = c.new_input("n int"), d.new_input("n int")
    with pytest.raises(ContextMismatch):
        r.concat(s)
    o = r.map_h("n").distinct().named("numbers").into_output()
    x = c.begin()
    i.add_all([(1,), (1,), (2,)])
    x.commit()
    o.get(x)
    out = io.StringIO()
    x.dump_dot(out)
    assert "numbers\\ndistinct\\n2" in out.getvalue() and "input\\n3" in out.getvalue() and 'label="map' not in out.getvalue()


def test_changes_add_up_to_snapshots(spark):
    """Every operator with state, on random signed changes with nulls: what changes add up to is what a snapshot gives."""
    c = CreationContext(spark)
    ia, a = c.new_input("k int, v int")
    ib, b = c.new_input("k int, u int")
    made = {
        "join": (a.join(b, "k"), lambda a, b: a.join(b, "k")),
        "anti": (a.antijoin(b, "k"), lambda a, b: a.antijoin(b, "k")),
        "left": (a.left_join(b, "k"), lambda a, b: a.left_join(b, "k")),
        "max": (a.group_max("k"), lambda a, b: a.group_max("k")),
        "distinct": (a.fsts("k").distinct(), lambda a, b: a.fsts("k").distinct()),
    }
    outs = {n: r.into_output() for n, (r, _) in made.items()}
    x, rng = c.begin(), random.Random(11)
    all_a, all_b = [], []
    for _ in range(3):
        change = lambda: [(rng.choice([None, 1, 2, 3]), rng.randrange(3), rng.choice([-1, 1, 2])) for _ in range(4)]
        da, db = change(), change()
        all_a += da
        all_b += db
        ia.send_all(da)
        ib.send_all(db)
        x.commit()
        za, zb = rows_of(spark, all_a, "k int, v int", None), rows_of(spark, all_b, "k int, u int", None)
        for n, (_, f) in made.items():
            assert ZFrame(outs[n].get(x)) == f(za, zb), n


def test_records_of_a_game_graph(spark):
    """The counts of change records that don't depend on the order of propagation, in the dump: positions with copies, positions, children."""
    x, *_ = fingers(spark, count_records=True)
    out = io.StringIO()
    x.dump_dot(out)
    labels = dict(re.findall(r'label="(\w+)\\n\w+\\n(\d+)"', out.getvalue()))
    assert {k: int(labels[k]) for k in ("positions_dupped", "positions", "starting_values", "pos_children")} == {"positions_dupped": 3085, "positions": 1163, "starting_values": 1163, "pos_children": 3084}


def test_interrupts_have_the_type_that_was_named(spark):
    for kind, fine in ((int, True), (str, False)):
        c = CreationContext.new_(spark, kind)
        i, r = c.new_input("n int")
        c.interrupt(r.into_output(), lambda df: df.count())
        x = c.begin()
        i.add(1)
        if fine:
            assert x.commit() == 1
        else:
            with pytest.raises(TypeError):
                x.commit()
    c = CreationContext.new(spark)
    _, r = c.new_input("n int")
    with pytest.raises(TypeError):
        c.interrupt(r.into_output())


def test_indices_handles_and_reductions(spark):
    c = CreationContext(spark)
    i, r = c.new_input("k int, v int")
    heard = []
    i.add_listener(heard.append)
    best, results = r.reduce_with_output_("k", lambda z: z.reduce("k", F.max("v").alias("v")), lambda z: z.map("v").consolidate().df.drop("w"))
    o = best.into_output()
    assert (i.tracking_index, r.tracking_index, best.tracking_index, o.tracking_index) == (0, 0, 1, 3)
    assert best.is_reduce and not r.is_reduce and results.get_relation() is best
    x = c.begin()
    i.add_all([(1, 2), (1, 3)])
    i.clone().add(2, 5)
    x.commit()
    assert rows(o.get(x)) == [(1, 3, 1), (2, 5, 1)] and rows(results.inspect(x)) == [(3,), (5,)] and len(heard) == 2


def test_keys_go_one_by_one(spark, monkeypatch):
    """A change with many keys, some null, some that cancel: each goes once, in order, however often what is left is put together."""
    monkeypatch.setattr(OrderedFeed, "MOST_GONE", 2)
    c = CreationContext(spark)
    i, r = c.new_input("k int, v int")
    target, got = c.new_input("v int")
    order = []
    target.add_listener(lambda df: order.append(sorted(x["v"] for x in df.collect())))
    c.feed_ordered(r, target, "k")
    o, x = got.into_output(), c.begin()
    i.send_all([(k, 10 * k, 1) for k in (5, 1, 4, 3)] + [(1, 11, 2), (None, 7, 1), (2, 20, 1), (2, 20, -1), (6, 60, 1)])
    x.commit()
    assert order == [[7], [10, 11], [30], [40], [50], [60]]
    i.send_all([(3, 31, 1), (None, 8, 1)])
    x.commit()
    assert order[6:] == [[8], [31]] and sorted(map(tuple, o.get(x).collect())) == [(7, 1), (8, 1), (10, 1), (11, 2), (30, 1), (31, 1), (40, 1), (50, 1), (60, 1)]
