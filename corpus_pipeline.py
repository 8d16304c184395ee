"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import decontaminate, langid, line_dedup, mixing, simhash
from tidelake.llm.common import checkpointed, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Running text takes its language's model about 2 bits a byte, a line around a hex key up to 6, base64 or another script 7 to 9. A text goes if the best model
#: takes more than so many a byte, and so many besides, which a short text may take to get going.
MOST_BITS, START_BITS = 6.0, 64.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that no language's model codes in MOST_BITS a byte (and START_BITS). Languages are learnt from ``docs``.

    Null and empty text: no letter, goes. Long texts: judged whole. Repeated rows and ties: alike. Null ids stay. No document with a label, so no language to
    tell: all with a letter stay. Empty table: no rows. Other columns, whatever their names, stay as they are.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id")
    found = langid.identify(rows, model)
    size = F.octet_length("text")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") * size <= MOST_BITS * size + START_BITS))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that five or more documents share out of all but one; texts and n_chars change, documents stay.

    Null text becomes an empty one. Empty and long texts, ties, null ids, repeated rows: as in ``dedup_lines``. Empty table: no rows. Other columns, whatever
    their names, stay as they are.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = line_dedup.dedup_lines(rows)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, similarity 0.8).

    Null and empty texts and those of spaces only are copies of each other. Long texts: whole. Null ids come last; ties and repeated rows: as in
    ``drop_near_duplicates``, one stays. Empty table: no rows. Other columns, whatever their names, stay as they are.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark: eight words in a row of one item, or the whole of an item that has fewer, once or more.

    Null and empty texts stay, as do null ids. Long texts: searched whole. Repeated rows and ties: alike. Empty table or benchmark: nothing goes. Other columns,
    whatever their names, stay as they are.
    """
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = decontaminate.decontaminate(rows, read(spark, sf_dir, "benchmark"), min_items=1)
    return found.where(~F.col("contaminated")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, and how many: their columns, size, source_size, target and taken.

    Null and empty texts have no words and go, whatever their ids. Long texts: in as many blocks as they fill. Null source: a source of its own. Repeated rows:
    each is a document; ties: as in ``mix_sources``. Empty table: no rows. Columns named like the four new ones are replaced.
    """
    return mixing.mix_sources(docs)[0].where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_stage),
    ("mix", mix),
]
#: SQL has no byte models and no SimHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
