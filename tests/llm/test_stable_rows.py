"""Operators that read their input twice, and the pipeline, on inputs whose rows come in other partitions each time they are read."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import decontaminate, line_dedup, mixing, secrets, simhash

DATA = Path("/root/testdata/sf0.01")
SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.shuffle.partitions": "40"}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(str(DATA / "documents.parquet"))


@pytest.fixture
def small_parts(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def shuffled(docs):
    """The same rows behind a shuffle, which adaptive execution cuts by the bytes of the columns that are read."""
    return docs.repartition(40, "source").join(docs.select("source").distinct(), "source").select(*docs.columns)


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_operators(spark, docs, small_parts):
    tests = spark.read.parquet(str(DATA / "benchmark.parquet"))
    moved = shuffled(docs)
    for name, f, columns in (
        ("lines", line_dedup.dedup_lines, ("doc_id", "kept_text", "n_dropped")),
        ("secrets", secrets.scan_secrets, ("doc_id", "blob", "secret_spans")),
        ("near", simhash.drop_near_duplicates, docs.columns),
        ("mix", lambda d: mixing.mix_sources(d)[0], ("doc_id", "size", "target", "taken")),
        ("benchmark in blocks", lambda d: decontaminate.decontaminate(d, tests, block_bytes=2000), ("doc_id", "n_words", "n_hit", "items")),
    ):
        assert rows(f(moved), *columns) == rows(f(docs), *columns), name


def test_pipeline(spark, docs, small_parts, tmp_path):
    staged = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, staged, str(DATA)).write.parquet(str(tmp_path / name))
        staged = spark.read.parquet(str(tmp_path / name))
    (tmp_path / "in").mkdir()
    shuffled(docs).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.read.parquet(str(DATA / "benchmark.parquet")).write.parquet(str(tmp_path / "in" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert got.columns == staged.columns and rows(got, *got.columns) == rows(staged, *got.columns)
    assert 0.7 * docs.count() < got.where(F.col("taken") > 0).count()
