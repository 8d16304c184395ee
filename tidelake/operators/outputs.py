"""Layouts of results: flat, by key, ordered by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import W, ZFrame, _list


def flat(z: ZFrame) -> DataFrame:
    """Rows and their net counts."""
    return z.consolidate().df


def by_key(z: ZFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row for each key with ``entries``: an array of (values, w), sorted; structs, since map keys can't be null."""
    values = [c for c in z.columns if c not in _list(keys)]
    return z.consolidate().df.groupBy(*_list(keys)).agg(F.array_sort(F.collect_list(F.struct(*values, W))).alias("entries"))


def extrema(z: ZFrame, keys: str | Sequence[str]) -> DataFrame:
    """As ``by_key``, in order of the keys, for reading the smallest or largest."""
    return by_key(z, keys).orderBy(*_list(keys))


def scalar(z: ZFrame) -> DataFrame:
    """The net count of all rows; no row where it is 0."""
    return z.map().consolidate().df
