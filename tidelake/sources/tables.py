"""Tables as signed multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidelake.operators.frame import ZFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str, *columns: Column | str, weight: Column | int = 1) -> ZFrame:
    """Columns of a table, each row with ``weight``; only these columns are read."""
    df = table(spark, sf_dir, name)
    z = ZFrame.of(df, weight)
    return z.map(*columns) if columns else z
