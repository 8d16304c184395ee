"""Written intermediate results, and state kept by key as a few of them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import AtomicType, BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

W = "w"


def checkpoint_folder(df: DataFrame) -> str | None:
    """The folder of spark.checkpoint.dir, or what was set on the context."""
    session = df.sparkSession
    return session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is that of spark.checkpoint.dir. Where it is unset, a local session (one process, as in tests) gets a folder of its own; on
    a cluster that would be a folder of one machine, which others don't see, so it is an error.
    """
    sc = df.sparkSession.sparkContext
    if not checkpoint_folder(df):
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelake-"))
    return df.checkpoint(eager=True)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rows up to which a result is kept in plans as a local relation, and bytes of the values of one row that aren't of a fixed size. Larger ones are written to the checkpoint folder.
FEW, ROW_BYTES = 40_000, 512
#: A part of a state is merged with the one before it while that has up to so many times its rows.
GROWTH = 2
#: Rows from which on a part is kept in folders by bucket of its key, and rows of a bucket.
MANY, BUCKET_ROWS = 2_000_000, 250_000
BUCKET = "__bucket"


class Change(NamedTuple):
    """Consolidated rows, computed once: how many, and the rows themselves where they are few."""

    df: DataFrame
    rows: int
    local: pa.Table | None


def fetched(df: DataFrame) -> pa.Table | None:
    """The rows of ``df`` if they are few and small, else None. At most FEW + 1 rows come to the driver, of bounded size."""
    already = evaluated(df.limit(FEW + 1))
    if already is not None:
        return already if already.num_rows <= FEW else None
    loose = [f.name for f in df.schema.fields if not isinstance(f.dataType, AtomicType) or isinstance(f.dataType, (StringType, BinaryType))]
    if not loose:
        got = df.limit(FEW + 1).toArrow()
        return got if got.num_rows <= FEW else None
    plain = [c for c in loose if isinstance(df.schema[c].dataType, (StringType, BinaryType))]
    other = [c for c in loose if c not in plain]
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in plain] + ([F.octet_length(F.to_json(F.struct(*other)))] if other else []))
    got = df.select((size <= ROW_BYTES).alias("__small"), *[F.when(size <= ROW_BYTES, F.col(c)).alias(c) for c in df.columns]).limit(FEW + 1).toArrow()
    return got.select(df.columns) if got.num_rows <= FEW and pc.all(got["__small"], min_count=0).as_py() else None


#: Types whose Python values are the same in Arrow.
SAME = (BooleanType, ByteType, ShortType, IntegerType, LongType, StringType)


def evaluated(df: DataFrame) -> pa.Table | None:
    """The rows of a plan over local relations that the optimiser has worked out already, which takes no job; else None."""
    if not all(isinstance(f.dataType, SAME) for f in df.schema.fields) or df._jdf.queryExecution().optimizedPlan().nodeName() != "LocalRelation":
        return None
    columns = list(zip(*df.collect(), strict=True)) or [()] * len(df.columns)
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, to_arrow_schema(df.schema).types, strict=True)], df.columns)


def summed(table: pa.Table, schema: StructType) -> pa.Table | None:
    """Consolidated rows, or None if that takes Spark: floats (whose equal values differ in bits) and nested types."""
    names = [c for c in table.column_names if c != W]
    if any(not isinstance(schema[c].dataType, AtomicType) or isinstance(schema[c].dataType, (FloatType, DoubleType)) for c in names):
        return None
    if not names:
        n = pc.sum(table[W]).as_py() or 0
        return pa.table({W: pa.array([n] if n else [], pa.int64())})
    got = table.group_by(names, use_threads=False).aggregate([(W, "sum")]).rename_columns([*names, W])
    return got.filter(pc.not_equal(got[W], 0)).select(table.column_names)


def as_change(df: DataFrame, table: pa.Table) -> Change:
    return Change(df.sparkSession.createDataFrame(table, df.schema), table.num_rows, table)


def consolidated(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row for each different one; dealt out by the key, so that what is joined or grouped by it needn't move again."""
    names = [c for c in df.columns if c != W]
    if keys:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    if not names:
        return df.groupBy(F.lit(0).alias("__u")).agg(F.sum(W).alias(W)).where(f"{W} <> 0").select(W)
    return df.groupBy(*names).agg(F.sum(W).alias(W)).where(f"{W} <> 0").select(*df.columns)


class Part(NamedTuple):
    """Rows of a state. ``buckets``: into how many folders they are dealt by their key, if they are."""

    change: Change
    buckets: int = 0


class State:
    """A signed multiset as parts of falling size.

    A part is merged with the one before it unless that is more than GROWTH times as large, so there are about log n parts, and each row is written about log n
    times. Small parts are merged on the driver. Large ones lie in folders by bucket of their key: ``at`` then reads only the
    buckets of the keys that are asked for.
    """

    def __init__(self, empty: DataFrame, keys: Sequence[str] | None = None):
        self.empty, self.keys, self.parts = empty, list(keys or ()), []
        # Equal floats may differ in bits, and so in their bucket.
        self.dealt = bool(self.keys) and not any(isinstance(empty.schema[k].dataType, (FloatType, DoubleType)) for k in self.keys)

    def add(self, change: Change) -> None:
        self.parts.append(Part(change))
        while len(self.parts) > 1 and self.parts[-2].change.rows <= GROWTH * self.parts[-1].change.rows:
            b, a = self.parts.pop(), self.parts.pop()
            merged = self._merged(a.change, b.change)
            if merged.rows:
                self.parts.append(Part(merged))
        if self.parts and self.dealt and self.parts[-1].change.rows >= MANY and not self.parts[-1].buckets:
            self.parts[-1] = self._bucketed(self.parts[-1].change)

    def _merged(self, a: Change, b: Change) -> Change:
        if a.local is not None and b.local is not None and a.rows + b.rows <= FEW:
            table = summed(pa.concat_tables([a.local, b.local.select(a.local.column_names)], promote_options="permissive"), self.empty.schema)
            if table is not None:
                return as_change(self.empty, table)
        # A part in folders has its bucket as a column, which isn't part of the row.
        df = checkpointed(consolidated(a.df.drop(BUCKET).unionByName(b.df.drop(BUCKET)), self.keys))
        return Change(df, df.count(), None)

    def _bucket(self, n: int):
        return F.pmod(F.hash(*self.keys), F.lit(n))

    def _bucketed(self, change: Change) -> Part:
        n, folder = -(-change.rows // BUCKET_ROWS), checkpoint_folder(change.df)
        path = f"{folder.rstrip('/')}/tidelake-state-{uuid.uuid4().hex}"
        change.df.withColumn(BUCKET, self._bucket(n)).repartition(n, BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET).parquet(path)
        schema = StructType(list(change.df.schema.fields)).add(BUCKET, IntegerType())
        return Part(Change(change.df.sparkSession.read.schema(schema).parquet(path), change.rows, None), n)

    @property
    def rows(self) -> int:
        return sum(p.change.rows for p in self.parts)

    def frame(self) -> DataFrame:
        return union([p.change.df.drop(BUCKET) for p in self.parts]) if self.parts else self.empty

    def at(self, keys: Change) -> DataFrame:
        """Rows whose key may be among ``keys`` (the key's columns, of any types that compare with ours): of large parts only the buckets that these are in."""
        if not any(p.buckets for p in self.parts) or keys.local is None:
            return self.frame()
        out = []
        for p in self.parts:
            df = p.change.df
            if p.buckets:
                same = keys.df.select(*[F.col(k).try_cast(self.empty.schema[k].dataType).alias(k) for k in self.keys])
                wanted = sorted(r[0] for r in same.select(self._bucket(p.buckets)).distinct().collect())
                df = df.where(F.col(BUCKET).isin(wanted)) if len(wanted) < p.buckets else df
            out.append(df.drop(BUCKET))
        return union(out)
