"""Line dedup: lines that many documents share stay in one of them only.  DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALL, KEY, ascii_lower, checkpointed, strip, text_key, with_columns


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(strip(line))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped`` added.

    Lines are exploded, normalised (stripped, A-Z lower-cased) and hashed (MD5, 16 bytes); distinct documents are
    counted per hash; a line whose key has ``min_chars`` code points and occurs in ``min_docs`` documents is dropped
    in all but the largest id that holds it; the rest is put together by position.

    Only hashes and positions are shuffled for the counting, and lines are taken apart once: text moves once, for the last join. Rows are known by
    their id and their text's MD5, however the table is cut when it is read again. Lines and the
    frequent hashes are checkpointed, so that a very common line is joined by a sort-merge join which
    adaptive execution can split.

    Null or empty text: one empty line, kept.  Long texts: as any, their dropped positions are one array.  Null ids: one document, below all
    others.  Repeated rows: one document, each row treated alike.  Ties: a line that its last document holds twice stays twice.  Empty table: no
    rows.  Columns named like the three results are replaced.
    """
    lines = checkpointed(
        docs.select(text_key(id_col, F.col(text_col)).alias(KEY), F.posexplode(F.transform(split_lines(F.col(text_col)), line_key)).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select(KEY, "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"))
    )
    frequent = (
        lines.groupBy("hash")
        .agg(F.countDistinct(F.struct(f"{KEY}.id")).alias("n"), F.max(F.struct(f"{KEY}.id"))["id"].alias("last"))
        .where(F.col("n") >= min_docs)
        .select(F.col("hash").alias("h"), "last")
    )
    dropped = (
        lines.join(checkpointed(frequent), F.col("hash") == F.col("h"))
        .where(~F.col(f"{KEY}.id").eqNullSafe(F.col("last")))
        .groupBy(F.col(KEY).alias("k"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    rows = docs.select(F.struct(*docs.columns).alias(ALL), text_key(id_col, F.col(text_col)).alias(KEY))
    whole = split_lines(F.col(ALL)[text_col])
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("gone")), lambda i: F.get(whole, i))
    return rows.join(dropped, F.col(KEY) == F.col("k"), "left").select(
        *with_columns(
            docs,
            ALL,
            {
                "kept_text": F.when(F.col("gone").isNull(), F.coalesce(F.col(ALL)[text_col], F.lit(""))).otherwise(F.array_join(kept, "\n")),
                "n_lines": F.size(whole).cast("long"),
                "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
            },
        )
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
