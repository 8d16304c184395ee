"""Small expressions that queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: Column | str) -> Column:
    """Money as a whole number, so that it can be a key and sums are exact."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("bigint")


def fst(pair: str) -> Column:
    return F.col(pair).getField("_1")


def snd(pair: str) -> Column:
    return F.col(pair).getField("_2")


def swap(pair: str) -> Column:
    return F.struct(snd(pair).alias("_1"), fst(pair).alias("_2"))


#: Outcomes of games in their order: a win of player 1 in n plies is WIN - n, a draw 0, a win of player 2 in n plies n - WIN.
WIN = 1000


def one_ply_later(score: Column) -> Column:
    return score - F.signum(score).cast("bigint")
