"""Benchmark decontamination by Wu-Manber search for word windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType
from pyspark.sql.window import Window

from .common import ALL, FOLD, IS_ALNUM, KEY, checkpointed, runs, text_batches, text_key

WINDOW = 8
MIN_ITEMS = 2
#: Bytes of benchmark text in one search, and so in one broadcast; a larger benchmark is searched for in several passes.
BLOCK_BYTES = 4 << 20
#: Patterns are searched for by class of length, so that a short one doesn't shorten the others' shifts; each class begins at so many bytes.
CLASSES = (1, 3, 8, 20)
HASH_BITS = 18
#: Our own column: what is found in a text.
FOUND = "__tl_found"
FOUND_TYPE = StructType().add("n_words", LongType()).add("ranges", ArrayType(StructType().add("first", LongType()).add("end", LongType()))).add("items", ArrayType(StringType()))


class Patterns(NamedTuple):
    """One class of patterns: the length of the shortest, the bytes of a block, tables by block hash, and buckets of patterns by the hashes of their block at that length's end and of their beginning."""

    least: int
    block: int
    shift: np.ndarray
    buckets: dict[tuple[int, bytes], list[tuple[bytes, int, tuple[str, ...]]]]
    heads: int


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, folded, a space after each and a zero byte before each text; where the words begin; the text of each word."""
    data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    word = IS_ALNUM[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    out = np.where(word, FOLD[data], 32).astype(np.uint8)
    # A text's zero byte is also the byte after the last word before it; it is kept twice then.
    twice = np.ones(len(data), np.int64) * keep
    ends_word = np.zeros(len(texts), bool)
    ends_word[1:] = word[first[1:] - 1]
    twice[first] = 1 + ends_word
    place = np.cumsum(twice)
    buffer = np.repeat(out, twice)
    buffer[place[first] - 1] = 0
    starts, _ = runs(word)
    return buffer, place[starts] - 1, np.searchsorted(first, starts, side="right") - 1


def block_hash(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Of the ``block`` bytes up to and with each place."""
    h = data[at].astype(np.uint32)
    for k in range(1, block):
        h = (h << np.uint32(8)) | data[at - k]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def windows_of(text: bytes, window: int = WINDOW) -> dict[bytes, int]:
    """The windows of a text, each word with a space after it, and their numbers of words."""
    buffer, starts, _ = normalised([text])
    words = buffer.tobytes()
    n = len(starts)
    cuts = [*starts.tolist(), len(words) - 1 if words.endswith(b"\0") else len(words)]
    if not n:
        return {}
    k = min(window, n)
    return {words[cuts[i] : cuts[i + k]]: k for i in range(n - k + 1)}


def compile_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Patterns]:
    """Shift tables and buckets for every window of every item, by class of length."""
    owners: dict[bytes, set[str]] = {}
    sizes: dict[bytes, int] = {}
    for name, text in items:
        for w, k in windows_of(text, window).items():
            owners.setdefault(w, set()).add(name)
            sizes[w] = k
    out = []
    for lo, hi in zip(CLASSES, [*CLASSES[1:], 1 << 60], strict=True):
        group = sorted(w for w in owners if lo <= len(w) < hi)
        if not group:
            continue
        least = min(map(len, group))
        block = min(3, least)
        heads = min(4, least)
        shift = np.full(1 << HASH_BITS, least - block + 1, np.int64)
        table = np.frombuffer(b"".join(w[:least] for w in group), np.uint8).reshape(len(group), least)
        for end in range(block - 1, least):
            at = np.arange(len(group)) * least + end
            np.minimum.at(shift, block_hash(table.ravel(), at, block), least - 1 - end)
        last = block_hash(table.ravel(), np.arange(len(group)) * least + least - 1, block)
        buckets: dict[tuple[int, bytes], list] = {}
        for w, h in zip(group, last.tolist(), strict=True):
            buckets.setdefault((h, w[:heads]), []).append((w, sizes[w], tuple(sorted(owners[w]))))
        out.append(Patterns(least, block, shift, buckets, heads))
    return out


def occurrences(buffer: np.ndarray, patterns: Patterns, lane: int = 1024) -> list[tuple[int, int, tuple[str, ...]]]:
    """(place, words, items) of each occurrence that begins at a word.

    The buffer is cut into lanes that are scanned side by side: each looks at the block that ends where a shortest
    pattern would, and moves on by the block's shift; a shift of 0 makes a candidate, whose bucket's patterns are compared.
    """
    n, m = len(buffer), patterns.least
    if n < m:
        return []
    at = np.arange(m - 1, n, lane)
    stop = np.minimum(at + lane, n)
    found = []
    while len(at):
        h = block_hash(buffer, at, patterns.block)
        step = patterns.shift[h]
        zero = step == 0
        if zero.any():
            start = at[zero] - m + 1
            own = buffer[start - 1] <= 32  # a word begins there; the buffer begins with a zero byte
            found.append(np.stack([start[own], h[zero][own].astype(np.int64)]))
        at = at + np.where(zero, 1, step)
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    out = []
    text = buffer.tobytes()
    for start, h in (np.concatenate(found, axis=1).T.tolist() if found else []):
        for w, k, items in patterns.buckets.get((h, text[start : start + patterns.heads]), ()):
            if text.startswith(w, start):
                out.append((start, k, items))
    return out


def search(texts: list[bytes], compiled: list[Patterns]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Of each text: its number of words, word ranges in occurrences, items with occurrences."""
    buffer, starts, owner = normalised(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [(int(b - a), [], set()) for a, b in zip(first[:-1], first[1:], strict=True)]
    for p in compiled:
        hits = occurrences(buffer, p)
        word = np.searchsorted(starts, np.array([x[0] for x in hits], np.int64))
        for w, (_, k, items) in zip(word.tolist(), hits, strict=True):
            d = int(owner[w])
            out[d][1].append((w - int(first[d]), w - int(first[d]) + k))
            out[d][2].update(items)
    return out


def decontaminate(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words in an occurrence), ``items`` (sorted as text) and ``contaminated`` (``min_items`` items or more) added.

    A window is ``window`` consecutive words of an item; a shorter item is one window.  A benchmark of up to ``block_bytes`` is broadcast,
    its size checked, and the search is a map over rows.  A larger one is dealt into blocks of that size by running sums of sizes (an
    item may be in several rows); each block is searched for in the different texts, and the parts are put together by the texts' MD5.

    Null text: no words.  Long texts are searched whole; a long item makes a large block by itself.  Null item id: named as an empty text.  Repeated
    items count once by id.  Ties: none, items are sorted by name.  Empty benchmark: nothing is
    hit.  Empty table: no rows.  Repeated rows and null ids pass through.  Columns named like the results are replaced.
    """
    items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kept = [c for c in docs.columns if c.lower() not in {"n_words", "n_hit", "items", "contaminated"}]
    text = next(c for c in kept if c.lower() == text_col.lower())
    if total <= block_bytes:
        frame = docs.select(*kept)
        schema = StructType(list(frame.schema.fields)).add(FOUND, FOUND_TYPE)
        found = frame.mapInArrow(_searcher(_broadcast(items, window), kept.index(text), True), schema)
    else:
        texts = checkpointed(docs.select(text_key(None, F.col(text)).alias(KEY), F.col(text).alias("text")).dropDuplicates([KEY]))
        schema = StructType().add(KEY, texts.schema[KEY].dataType).add(FOUND, FOUND_TYPE)
        parts = []
        for block in _blocks(items, total, block_bytes):
            hit = texts.mapInArrow(_searcher(_broadcast(block, window), 1, False), schema)
            parts.append(checkpointed(hit if not parts else hit.where(F.size(F.col(FOUND)["items"]) > 0)))
        whole = (
            reduce(DataFrame.unionByName, parts)
            .groupBy(F.col(KEY).alias("k"))
            .agg(F.struct(F.max(F.col(FOUND)["n_words"]).alias("n_words"), F.flatten(F.collect_list(F.col(FOUND)["ranges"])).alias("ranges"), F.array_distinct(F.flatten(F.collect_list(F.col(FOUND)["items"]))).alias("items")).alias(FOUND))
        )
        rows = docs.select(F.struct(*kept).alias(ALL), text_key(None, F.col(text)).alias(KEY))
        found = rows.join(checkpointed(whole), F.col(KEY) == F.col("k")).select(*[F.col(ALL)[c].alias(c) for c in kept], FOUND)
    got = F.col(FOUND)
    # Ranges are merged in order of their beginnings: what each adds is what is past the furthest end so far.
    merged = F.aggregate(
        F.array_sort(got["ranges"]),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["first"], s["reach"]))).alias("n"), F.greatest(s["reach"], x["end"]).alias("reach")),
    )["n"]
    return found.select(*kept, got["n_words"].alias("n_words"), merged.alias("n_hit"), F.array_sort(got["items"]).alias("items"), (F.size(got["items"]) >= min_items).alias("contaminated"))


def _blocks(items: DataFrame, total: int, block_bytes: int) -> Iterator[DataFrame]:
    """The rows of the benchmark in blocks of at most ``block_bytes``, or one row: numbered by running sums of sizes, within buckets of rows and over the buckets' sums, and written once."""
    buckets = -(-total // block_bytes)
    dealt = checkpointed(items.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(buckets))))
    sums = dealt.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    inside = Window.partitionBy("bucket").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1)
    place = dealt.withColumn("within", F.coalesce(F.sum(F.octet_length("text")).over(inside), F.lit(0))).join(sums.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")), "bucket")
    # A row that begins in the first half of a block and one that begins in its second half are in different ones, so rows of up to half a block fill none beyond its size.
    cut = checkpointed(place.select("item", "text", F.floor((F.col("before") + F.col("within")) / F.lit(max(1, block_bytes // 2))).alias("block")))
    for row in cut.select("block").distinct().orderBy("block").toLocalIterator():
        yield cut.where(F.col("block") == row["block"]).select("item", "text")


def _broadcast(items: DataFrame, window: int):
    rows = [(r["item"], r["text"].encode()) for r in items.collect()]
    return items.sparkSession.sparkContext.broadcast(compile_patterns(rows, window))


def _searcher(shared, at: int, whole: bool):
    """Rows (all their columns where ``whole``, else the first) with what is found in the text in column ``at``, as one struct."""
    ranges = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns if whole else batch.columns[:1]
            names = batch.schema.names if whole else batch.schema.names[:1]
            for a, b, texts in text_batches(batch, at):
                got = search(texts, shared.value)
                new = [pa.array([x[0] for x in got], pa.int64()), pa.array([[{"first": p, "end": q} for p, q in x[1]] for x in got], ranges), pa.array([sorted(x[2]) for x in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in columns], pa.StructArray.from_arrays(new, ["n_words", "ranges", "items"])], [*names, FOUND])

    return run


def query(docs: DataFrame, tests: DataFrame) -> DataFrame:
    return decontaminate(docs.select("doc_id", "text"), tests).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 8) AS k, unnest([array_to_string(w[i + 1 : i + least(len(w), 8)], ' ') for i in range(len(w) - least(len(w), 8) + 1)]) AS s FROM b WHERE len(w) > 0),
x AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
o AS (SELECT x.doc_id, x.i, n.k, array_to_string(x.w[x.i + 1 : x.i + n.k], ' ') AS s FROM x, (SELECT DISTINCT k FROM v) AS n WHERE x.i + n.k <= len(x.w)),
h AS (SELECT o.doc_id, o.i, v.k, v.item_id FROM o JOIN v ON o.s = v.s AND o.k = v.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
