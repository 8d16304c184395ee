"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, katz, langid, line_dedup, media, mixing, repeats, secrets, simhash, toxicity
from .common import read


def _over_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda spark, sf_dir: toxicity.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op2_language_id": _over_documents(langid.query),
    "op3_katz": _over_documents(katz.query),
    "op4_decontaminate": lambda spark, sf_dir: decontaminate.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op5_repeats": _over_documents(repeats.query),
    "op6_line_dedup": _over_documents(line_dedup.query),
    "op7_mix_sources": _over_documents(mixing.query),
    "op8_simhash": _over_documents(simhash.query),
    "op9_media": _over_documents(media.query),
    "op10_secret_scan": _over_documents(secrets.query),
}

ORACLES = {"op4_decontaminate": decontaminate.SQL, "op6_line_dedup": line_dedup.SQL, "op10_secret_scan": secrets.SQL}
