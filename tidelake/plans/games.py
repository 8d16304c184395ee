"""Two game graphs solved by feedback: positions by breadth, then values to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.values import WIN, one_ply_later

from .feedback import CreationContext

#: The lines of the board, by place from 1.
LINES = ((1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 4, 7), (2, 5, 8), (3, 6, 9), (1, 5, 9), (3, 5, 7))


def solve(spark: SparkSession, schema: str, start: tuple, children: Column, finished: Column, count_records: bool = False):
    """(context, outcome of every position, outcomes of unfinished ones, parent-child relation).

    A position has the columns of ``schema``, ``turn`` among them. ``children``: array of structs of these columns, empty at the
    end of the game. ``finished``: the score of a finished position, null for others; these start as draws.
    """
    c = CreationContext(spark, count_records)
    positions_in, dupped = c.new_input(schema)
    outcomes_in, outcomes = c.new_input(f"{schema}, score long")
    names = dupped.columns
    positions = dupped.named("positions_dupped").distinct().named("positions")
    both = positions.map(*names, children.alias("children"), finished.cast("long").alias("score"))
    moves, starting = both.split([*names, "children"], [*names, "score"])
    starting = starting.named("starting_values")
    pos_children = moves.flat_map(F.transform("children", lambda x: F.struct(*[F.col(n).alias(f"p_{n}") for n in names], *[x[n].alias(n) for n in names])), *[f"p_{n}" for n in names], *names).named("pos_children")
    c.feed(pos_children.map(*names), positions_in)
    child_outcomes = pos_children.join(outcomes.named("outcomes"), names).map(*[F.col(f"p_{n}").alias(n) for n in names], one_ply_later(F.col("score")).alias("score")).named("child_outcomes")
    best = F.when(F.max("turn") == 1, F.max("score")).otherwise(F.min("score")).alias("score")
    inner = child_outcomes.reduce(names, best).named("nonterminal_outcomes")
    probe = inner.probe()
    ends = starting.filter(F.col("score").isNotNull())
    draws = starting.filter(F.col("score").isNull()).map(*names, F.lit(0).cast("long").alias("score")).antijoin(inner.fsts(names), names)
    every = ends.concat(inner).concat(draws)
    c.feed(every, outcomes_in)
    out, edges = every.into_output(), pos_children.into_output()
    x = c.begin()
    positions_in.add(*start)
    x.commit()
    return x, out, probe, edges


def tic_tac_toe(spark: SparkSession, count_records: bool = False):
    mark = F.when(F.col("turn") == 1, "X").otherwise("O")
    won = lambda p: F.expr(" or ".join(" and ".join(f"substring(board, {i}, 1) = '{p}'" for i in line) for line in LINES))
    over = F.when(won("X"), F.lit(WIN)).when(won("O"), F.lit(-WIN)).when(~F.contains("board", F.lit("-")), F.lit(0))
    places = F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring("board", i, F.lit(1)) == "-")
    moved = F.transform(places, lambda i: F.struct(F.overlay("board", mark, i, F.lit(1)).alias("board"), (3 - F.col("turn")).alias("turn")))
    return solve(spark, "board string, turn int", ("-" * 9, 1), F.when(over.isNull(), moved).otherwise(F.slice(moved, 1, 0)), over, count_records)


def fingers(spark: SparkSession, count_records: bool = False):
    """Hands a, b of player 1 and c, d of player 2; a hand that isn't 0 hits another that isn't, which becomes the sum modulo 5."""
    mine, other = F.when(F.col("turn") == 1, F.array("a", "b")).otherwise(F.array("c", "d")), F.when(F.col("turn") == 1, F.array("c", "d")).otherwise(F.array("a", "b"))
    hit = lambda h, g, k: F.when((h != 0) & (g != 0), F.struct((h + g).alias("s"), F.lit(k).alias("k")))
    moves = F.array(*[hit(mine[i], other[k], k) for i in (0, 1) for k in (0, 1)])

    def after(m: Column) -> Column:
        new = [F.when(m["k"] == k, m["s"] % 5).otherwise(other[k]) for k in (0, 1)]
        first = F.col("turn") == 1
        return F.struct(*[F.when(first, x).otherwise(y).cast("int").alias(n) for n, x, y in (("a", F.col("a"), new[0]), ("b", F.col("b"), new[1]), ("c", new[0], F.col("c")), ("d", new[1], F.col("d")))], (3 - F.col("turn")).alias("turn"))

    lost = F.when((mine[0] == 0) & (mine[1] == 0), F.when(F.col("turn") == 1, F.lit(-WIN)).otherwise(F.lit(WIN)))
    children = F.transform(F.filter(moves, lambda m: m.isNotNull()), after)
    return solve(spark, "a int, b int, c int, d int, turn int", (1, 1, 1, 1, 1), F.when(lost.isNull(), children).otherwise(F.slice(children, 1, 0)), lost, count_records)


def summary(game) -> DataFrame:
    """One row: positions, parent-child records, unfinished positions, and how many of these each player wins."""
    _, out, probe, edges = game
    at = probe.inspect().agg(*[F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint").alias(n) for n, c in (("inner", F.lit(True)), ("p1", F.col("score") > 0), ("draw", F.col("score") == 0), ("p2", F.col("score") < 0))])
    return at.join(out.get().agg(F.sum("w").alias("positions"))).join(edges.get().agg(F.sum("w").alias("edges"))).select("positions", "edges", "inner", "p1", "draw", "p2")
