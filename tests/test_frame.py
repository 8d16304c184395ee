"""The algebra of signed multisets, on the fixtures of the survey and on random rows against a plain model."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelake.operators.frame import ZFrame, rows_of
from tidelake.operators.outputs import by_key, extrema, scalar

A = [(1, "a", 2), (1, "b", -1), (2, "a", 1), (None, "c", 1)]
B = [(1, 3), (None, 1), (3, 1)]


def got(z: ZFrame) -> dict:
    return {tuple(r)[:-1]: r["w"] for r in z.consolidate().df.select(*z.columns, "w").collect()}


@pytest.fixture(scope="module")
def a(spark):
    return rows_of(spark, A, "k int, v string", None)


@pytest.fixture(scope="module")
def b(spark):
    return rows_of(spark, B, "k int", None)


def test_joins(a, b):
    assert got(a.semijoin(b, "k")) == {(1, "a"): 6, (1, "b"): -3, (None, "c"): 1}
    assert got(a.antijoin(b, "k")) == {(2, "a"): 1}
    left = a.left_join(rows_of(a.df.sparkSession, [(1, "x", 2), (None, None, 1)], "k int, u string", None), "k")
    assert got(left) == {(1, "a", "x", True): 4, (1, "b", "x", True): -2, (2, "a", None, False): 1, (None, "c", None, True): 1}


def test_sets(a):
    assert got(a.distinct()) == {(1, "a"): 1, (1, "b"): 1, (2, "a"): 1, (None, "c"): 1}
    assert got(a.counts()) == {(1, "a", 2): 1, (1, "b", -1): 1, (2, "a", 1): 1, (None, "c", 1): 1}
    assert got(a.minus(a)) == {} and got(a.set_minus(a)) == {}
    assert got(a.intersection(a)) == {(1, "a"): 4, (1, "b"): 1, (2, "a"): 1, (None, "c"): 1}
    assert got(a.negate()) == {k: -w for k, w in got(a).items()}
    assert a == a.concat(a).minus(a)


def test_groups(a, spark):
    assert got(a.group_min("k")) == {(1, "a"): 1, (2, "a"): 1, (None, "c"): 1}
    assert got(a.group_max("k")) == {(1, "b"): 1, (2, "a"): 1, (None, "c"): 1}
    assert got(a.reduce("k", F.sum("w").alias("n"))) == {(1, 1): 1, (2, 1): 1, (None, 1): 1}
    empty = rows_of(spark, [], "v int")
    assert got(empty.group_min()) == {} and got(empty.reduce((), F.count("*").alias("n"))) == {}
    nulls = rows_of(spark, [(1, None), (1, 5)], "k int, v int")
    assert got(nulls.group_min("k")) == {(1, None): 1}


def test_linear(a, spark):
    assert got(a.map(F.upper("v").alias("v"))) == {("A",): 3, ("B",): -1, ("C",): 1}
    assert got(a.fsts("k")) == {(1,): 1, (2,): 1, (None,): 1}
    assert got(a.swaps("k")) == {k[::-1]: w for k, w in got(a).items()}
    assert got(a.filter("k = 2")) == {(2, "a"): 1}
    assert got(rows_of(spark, [([1, 2, 2],), ([],)], "x array<int>").flatten("x")) == {(1,): 1, (2,): 2}
    left, right = rows_of(spark, [(0,), (1,)], "x long").split([(F.col("x") * 2).alias("l")], [(F.col("x") * 2 + 1).alias("r")])
    assert got(left) == {(0,): 1, (2,): 1} and got(right) == {(1,): 1, (3,): 1}
    with pytest.raises(TypeError):
        a.t("k long, v string")
    assert a.t("k int, v string") is a


def test_outputs(a):
    rows = {r["k"]: [(e["v"], e["w"]) for e in r["entries"]] for r in by_key(a, "k").collect()}
    assert rows == {1: [("a", 2), ("b", -1)], 2: [("a", 1)], None: [("c", 1)]}
    assert [r["k"] for r in extrema(a, "k").collect()] == [None, 1, 2]
    assert scalar(a).first()["w"] == 3


def test_triangles(spark):
    rng = random.Random(3)
    rel = lambda n: Counter({(rng.randrange(4), rng.randrange(4)): rng.choice([-1, 1, 2]) for _ in range(n)})
    xy, xz, yz = rel(9), rel(9), rel(9)
    make = lambda c, names: rows_of(spark, [(*k, w) for k, w in c.items()], names, None)
    want = Counter()
    for (x, y), m in xy.items():
        for (x2, z), n in xz.items():
            if x == x2:
                want[x, y, z] += m * n * yz[y, z]
    assert got(make(xy, "x int, y int").triangles(make(xz, "x int, z int"), make(yz, "y int, z int"))) == {k: w for k, w in want.items() if w}
