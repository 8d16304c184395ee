"""The stages on the smallest tables, each on what the one before kept."""

from __future__ import annotations

import base64
import random
from pathlib import Path

import pytest

import corpus_pipeline

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert now and set(now) <= ids and len(now) == len(set(now))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        ids = set(now)
    assert set(columns) | {"taken", "target"} <= set(docs.columns)


#: Columns with the names that operators use for their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, ranges string, items string, key string, size long, kept_text string, lang_pred string, component string"
LINE = "This very line stands in at least five of all the documents here."


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "r", "x", "y", "k", 3, "t", "p", "c") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (None, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("the house and a garden were full of people who had come to see old trees by water quick brown fox jumps over lazy cat dog".split()) + rng.choice(["", "", "s", "ed"]) for _ in range(n))
    out = [(i, prose(60) + f" {i}", "en", f"s{i % 3}") for i in range(40)]
    junk = base64.b64encode(rng.randbytes(900)).decode()
    return out + [
        (100, None, "en", "s0"), (101, "", None, None), (102, " \n", "en", "s1"), (103, "!!! 123", None, "s1"), (104, junk, None, "s2"), (105, "Это совсем другой язык и другая азбука, " * 5, None, "s2"),
        (106, "a", None, "s0"), (107, prose(20_000), None, "s0"), (None, prose(50), None, "s1"), (None, prose(50), None, "s1"), (108, out[0][1], None, "s1"), (108, out[0][1], None, "s1"),
        *[(110 + i, f"{prose(30)}\n{LINE}\n{prose(30)}", None, "s2") for i in range(6)], (120, "see: The quick brown fox, jumps over the lazy cat", None, "s0"),
    ]


def ids(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.select("doc_id").collect())


def of(rows, *without):
    return sorted(i if i is not None else -1 for i, *_ in rows if i not in without)


def test_language_id_drops_what_is_no_language(spark, rows, folder):
    got = corpus_pipeline.language_id(spark, table(spark, rows), folder)
    assert got.columns == table(spark, rows).columns and ids(got) == of(rows, 100, 101, 102, 103, 104, 105)
    none = table(spark, [(i, t, None, s) for i, t, _, s in rows])
    assert ids(corpus_pipeline.language_id(spark, none, folder)) == of(rows, 100, 101, 102, 103)


def test_line_dedup(spark, rows, folder):
    docs = table(spark, rows)
    got = corpus_pipeline.line_dedup_stage(spark, docs, folder)
    assert got.columns == docs.columns and ids(got) == ids(docs)
    texts = {r["doc_id"]: r for r in got.collect()}
    assert [LINE in texts[i]["text"] for i in range(110, 116)] == [False] * 5 + [True]
    assert texts[100]["text"] == "" and all(r["n_chars"] == len(r["text"]) and r["kept_text"] == "t" for r in texts.values())


def test_near_dedup(spark, rows, folder):
    docs = table(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, folder)
    # Texts without words are one group, 108 is a copy of 0; the two of null id differ.
    assert got.columns == docs.columns and ids(got) == of(rows, 101, 102, 108)
    assert got.where("row <> 'r' OR component <> 'c'").isEmpty()


def test_decontaminate(spark, rows, folder):
    docs = table(spark, rows)
    got = corpus_pipeline.decontaminate_stage(spark, docs, folder)
    assert got.columns == docs.columns and ids(got) == of(rows, 120)
    assert got.where("ranges <> 'x' OR items <> 'y'").isEmpty()


def test_mix(spark, rows, folder):
    docs = table(spark, rows)
    got = corpus_pipeline.mix(spark, docs, folder)
    assert set(ids(got)) <= set(of(rows, 100, 101, 102)) and 107 in ids(got)
    assert got.where("size = 3 OR taken > 2 * size").isEmpty()


def test_empty_tables(spark, folder):
    none = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).isEmpty()
