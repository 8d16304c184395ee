"""Signed multisets (Z-sets): DataFrames whose column ``w`` says how often a row counts, negative counts included.

Every operator takes weights as they come, split over several equal rows or not; those that look at counts consolidate first.
All are lazy plans of Catalyst operators.  Rows match null-safely: a null equals a null.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

W = "w"
log = logging.getLogger("tidelake")


def _list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


class ZFrame:
    """A DataFrame with a weight column ``w`` (bigint, never null)."""

    def __init__(self, df: DataFrame):
        if W not in df.columns:
            raise ValueError("a column w is needed")
        self.df = df

    @classmethod
    def of(cls, df: DataFrame, weight: Column | int = 1) -> ZFrame:
        """Each row of ``df`` with the given weight."""
        c = weight if isinstance(weight, Column) else F.lit(weight)
        return cls(df.withColumn(W, c.cast("bigint")))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != W]

    @property
    def schema(self) -> StructType:
        return StructType([f for f in self.df.schema.fields if f.name != W])

    # Rows to rows: weights go along, equal results add up later.

    def map(self, *columns: Column | str) -> ZFrame:
        return ZFrame(self.df.select(*columns, W))

    def map_raw(self, *columns: Column | str) -> ZFrame:
        """Like map, but the weight is among the columns that the caller gives."""
        return ZFrame(self.df.select(*columns))

    def filter(self, condition: Column | str) -> ZFrame:
        return ZFrame(self.df.where(condition))

    def flat_map(self, array: Column, *names: str) -> ZFrame:
        """A row for each element of ``array``; a struct's fields become columns if names are given for them."""
        if len(names) < 2:
            return ZFrame(self.df.select(F.explode(array).alias(*(names or ("value",))), W))
        return ZFrame(self.df.select(F.explode(array).alias("__e"), W).select(*[F.col("__e").getField(i).alias(n) for i, n in zip(_fields(self.df, array), names, strict=True)], W))

    def flat_map_raw(self, array: Column) -> ZFrame:
        """A row for each struct in ``array``; one of its fields is w."""
        return ZFrame(self.df.select(F.explode(array).alias("__e")).select("__e.*"))

    def flatten(self, column: str, name: str = "value") -> ZFrame:
        return self.flat_map(F.col(column), name)

    def map_counts(self, f: Callable[[Column], Column]) -> ZFrame:
        """``f`` on the weight of each record, not on net counts: what it gives depends on how changes are batched, unless f is additive."""
        return ZFrame(self.df.withColumn(W, f(F.col(W)).cast("bigint")))

    def negate(self) -> ZFrame:
        return self.map_counts(lambda w: -w)

    def fsts(self, keys: str | Sequence[str]) -> ZFrame:
        """The key columns; no duplicates are removed."""
        return self.map(*_list(keys))

    def snds(self, keys: str | Sequence[str]) -> ZFrame:
        return self.map(*[c for c in self.columns if c not in _list(keys)])

    def swaps(self, keys: str | Sequence[str]) -> ZFrame:
        return self.map(*[c for c in self.columns if c not in _list(keys)], *_list(keys))

    def split(self, left: Sequence[Column | str], right: Sequence[Column | str]) -> tuple[ZFrame, ZFrame]:
        return self.map(*left), self.map(*right)

    # Bags.

    def consolidate(self) -> ZFrame:
        """One row for each different one, with its net weight; none where that is 0."""
        if not self.columns:
            return ZFrame(self.df.groupBy(F.lit(0).alias("__u")).agg(F.sum(W).alias(W)).where(f"{W} <> 0").select(W))
        return ZFrame(self.df.groupBy(*self.columns).agg(F.sum(W).alias(W)).where(f"{W} <> 0"))

    def concat(self, other: ZFrame) -> ZFrame:
        return ZFrame(self.df.unionByName(other.df))

    def minus(self, other: ZFrame) -> ZFrame:
        """Signed difference: nothing is clamped at 0."""
        return self.concat(other.negate())

    def intersection(self, other: ZFrame) -> ZFrame:
        """Products of counts, row by row."""
        return self.semijoin(other, self.columns)

    def set_minus(self, other: ZFrame) -> ZFrame:
        """Rows whose net count in ``other`` is 0, with their counts."""
        return self.antijoin(other, self.columns)

    def distinct(self) -> ZFrame:
        """Once each row whose net count isn't 0, be it negative."""
        return self.consolidate().map_counts(lambda w: F.lit(1))

    def counts(self, name: str = "n") -> ZFrame:
        """Each row with its net count as a column, once."""
        c = self.consolidate()
        return ZFrame(c.df.select(*c.columns, F.col(W).alias(name), F.lit(1).cast("bigint").alias(W)))

    # Joins.

    def join(self, other: ZFrame, on: str | Sequence[str]) -> ZFrame:
        """Key, left values, right values; weights multiply."""
        on = _list(on)
        right, match = other._renamed(on)
        rest = [c for c in self.columns if c not in on]
        clash = {c.lower() for c in self.columns} & {c.lower() for c in other.columns if c not in on}
        if clash:
            raise ValueError(f"both sides have {sorted(clash)}")
        joined = self.df.withColumnRenamed(W, "__lw").join(right.withColumnRenamed(W, "__rw"), match(self.df))
        return ZFrame(joined.select(*on, *rest, *[c for c in other.columns if c not in on], (F.col("__lw") * F.col("__rw")).alias(W)))

    def join_values(self, other: ZFrame, on: str | Sequence[str]) -> ZFrame:
        return self.join(other, on).snds(on)

    def semijoin(self, other: ZFrame, on: str | Sequence[str]) -> ZFrame:
        """Weights multiply with the keys' counts on the right: unlike SQL's semi join."""
        on = _list(on)
        return self.join(other.map(*on).consolidate(), on).map(*self.columns)

    def antijoin(self, other: ZFrame, on: str | Sequence[str]) -> ZFrame:
        """Rows whose key's net count on the right is 0; a negative one blocks as well."""
        on = _list(on)
        right, match = other.map(*on).consolidate()._renamed(on)
        return ZFrame(self.df.join(right.drop(W), match(self.df), "left_anti"))

    def having(self, keys: DataFrame, on: Sequence[str], small: bool) -> ZFrame:
        """Rows whose key is among the rows of ``keys``, which are broadcast if they are known to be few."""
        right, match = ZFrame.of(keys)._renamed(on)
        right = right.drop(W)
        return ZFrame(self.df.join(F.broadcast(right) if small else right, match(self.df), "left_semi"))

    def left_join(self, other: ZFrame, on: str | Sequence[str], matched: str = "matched") -> ZFrame:
        """join, and rows of keys with net count 0 on the right, with nulls; ``matched`` tells a null from no match.

        One outer join. A key whose counts on the right cancel out has both forms, so its rows on the right get one more, of nulls.
        """
        on = _list(on)
        right = other.consolidate().df.withColumn(matched, F.lit(True))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields if f.name not in on]
        net = right.groupBy(*on).agg(F.sum(W).alias(W)).where(f"{W} = 0")
        right = right.unionByName(net.select(*on, *none, F.lit(1).cast("bigint").alias(W), F.lit(False).alias(matched)))
        renamed, match = ZFrame(right)._renamed(on)
        joined = self.df.withColumnRenamed(W, "__lw").join(renamed.withColumnRenamed(W, "__rw"), match(self.df), "left")
        rest = [c for c in other.columns if c not in on]
        return ZFrame(joined.select(*self.columns, *rest, (F.col("__lw") * F.coalesce("__rw", F.lit(1))).alias(W), F.coalesce(matched, F.lit(False)).alias(matched)))

    def triangles(self, xz: ZFrame, yz: ZFrame, x: str = "x", y: str = "y", z: str = "z") -> ZFrame:
        """(x, y) with (x, z) and (y, z): products of the three counts.

        Two of the relations are joined first, on one column: those whose join is the smallest, which the products of degrees
        tell before anything is joined. So a value that is frequent in one place doesn't set the cost if another order avoids it.
        """
        xy, xz, yz = self.consolidate(), xz.consolidate(), yz.consolidate()
        first = smallest_join([(xy, xz, x), (xy, yz, y), (xz, yz, z)])
        if first == 2:
            return xz.join(yz, z).join(xy, [x, y]).map(x, y, z)
        return (xy.join(xz, x).join(yz, [y, z]) if first == 0 else xy.join(yz, y).join(xz, [x, z])).map(x, y, z)

    def _renamed(self, on: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], Column]]:
        """Own rows with key columns renamed, and the null-safe condition against the same columns of another."""
        df = self.df
        for k in on:
            df = df.withColumnRenamed(k, f"__r_{k}")
        return df, lambda left: fold(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"__r_{k}")) for k in on], F.lit(True))

    # Groups.

    def reduce(self, keys: str | Sequence[str], *aggregates: Column) -> ZFrame:
        """One row for each key with a row whose net count isn't 0: aggregates over its different values and their net counts ``w``.

        So ``F.sum(v * w)`` sums with multiplicity, and ``F.sum("w")`` counts.
        """
        keys, c = _list(keys), self.consolidate().df
        grouped = c.groupBy(*keys) if keys else c.groupBy(F.lit(0).alias("__u"))
        out = grouped.agg(*aggregates)
        return ZFrame.of(out if keys else out.drop("__u"))

    def reduce_entries(self, keys: str | Sequence[str], f: Callable[[Column], Column], name: str = "value") -> ZFrame:
        """``f`` of the array of structs (value columns, w) of each key, sorted by value; for results that no aggregate gives."""
        values = [c for c in self.columns if c not in _list(keys)]
        got = self.reduce(keys, F.array_sort(F.collect_list(F.struct(*values, W))).alias("__all"))
        return got.map(*_list(keys), f(F.col("__all")).alias(name))

    def reduce_table(self, keys: str | Sequence[str], f: Callable, schema: str) -> ZFrame:
        """``f`` of each key's rows and counts as an Arrow table, one row of ``schema`` back: the way for Python code."""
        return ZFrame.of(self.consolidate().df.groupBy(*_list(keys)).applyInArrow(f, schema))

    def group_min(self, keys: str | Sequence[str] = ()) -> ZFrame:
        """The smallest values (columns in order, null first) of each key among those whose net count isn't 0."""
        return self._extreme(keys, F.min)

    def group_max(self, keys: str | Sequence[str] = ()) -> ZFrame:
        return self._extreme(keys, F.max)

    def _extreme(self, keys: str | Sequence[str], f: Callable) -> ZFrame:
        values = [c for c in self.columns if c not in _list(keys)]
        got = self.reduce(keys, f(F.struct(*values)).alias("__v"))
        return ZFrame(got.df.select(*_list(keys), *[F.col("__v")[c].alias(c) for c in values], W))

    # Looking at them.

    def t(self, schema: StructType | str) -> ZFrame:
        """Itself, if the columns have these names and types."""
        want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        have = [(f.name, f.dataType) for f in self.schema.fields]
        if have != [(f.name, f.dataType) for f in want.fields]:
            raise TypeError(f"{self.schema.simpleString()} isn't {want.simpleString()}")
        return self

    def debug(self, name: str, condition: Column | str | None = None, most: int = 20) -> ZFrame:
        """Itself; where debug logging is on, some records (that meet the condition) are logged."""
        if log.isEnabledFor(logging.DEBUG):
            for row in (self.df if condition is None else self.df.where(condition)).take(most):
                log.debug("%s: %s", name, row)
        return self

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ZFrame) and self.minus(other).consolidate().df.isEmpty()

    __hash__ = None


def smallest_join(joins: Sequence[tuple[ZFrame, ZFrame, str]]) -> int:
    """Which of the joins (left, right, column) has the fewest rows: sums of products of the keys' degrees, in one job over the degrees alone."""
    sizes = []
    for k, (a, b, on) in enumerate(joins):
        left, right = (z.df.groupBy(F.struct(on).alias("k")).agg(F.count("*").cast("double").alias(n)) for z, n in ((a, "l"), (b, "r")))
        sizes.append(left.join(right, "k").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0.0)).alias("n")).withColumn("k", F.lit(k)))
    return fold(DataFrame.unionByName, sizes).orderBy("n", "k").first()["k"]


def _fields(df: DataFrame, array: Column) -> list[str]:
    return df.select(array.alias("a")).schema["a"].dataType.elementType.names


def rows_of(spark, rows: Iterable, schema: str | StructType, weight: int | None = 1) -> ZFrame:
    """A ZFrame of Python rows; with ``weight`` None the rows end with their weight."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if weight is None:
        return ZFrame(spark.createDataFrame(list(rows), StructType(list(want.fields)).add(W, "long", False)))
    return ZFrame.of(spark.createDataFrame(list(rows), want), weight)
