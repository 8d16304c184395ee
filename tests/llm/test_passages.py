"""The decontamination stage on a benchmark with items shorter than a window."""

from __future__ import annotations

import corpus_pipeline


def test_passages_and_whole_short_items_go(spark, tmp_path):
    long = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"
    spark.createDataFrame([(1, long), (2, "short item of five words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "x A2, a3 a4 a5 a6 a7 a8 a9 y"), (2, "x a1 a2 a3 a4 a5 a6 a7 y a4 a5 a6 a7 a8 a9 a10"), (3, "see: Short item of five words."), (4, "short item of five, then short item of words"), (5, None)]
    got = corpus_pipeline.decontaminate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert got.columns == ["doc_id", "text"] and {r["doc_id"] for r in got.collect()} == {2, 4, 5}
