"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALL, ROW, checkpointed, crc, mix64, strip

WEIGHTS = (5, 2, 1)
BLOCK = 32
SLOTS_PER_SHARD = 4096
ROWS_PER_CHUNK = 500
#: Slots made in a task, about.
SLOTS_PER_TASK = 1 << 18
#: A row for each source is held by the driver, and by the task that sets the targets.
MOST_SOURCES = 1_000_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, ..) -> the same with ``target``.

    Sources by code point, null last, have ``weights`` in turn and share ``share`` times all sizes; a target stops at ``most``
    times its source's size, and the excess is shared again by weight.  That ends at min(cap, level x weight), where the
    level is that at which the targets sum up; sorted by cap / weight, the first k sources are at their
    caps, and of the levels that this gives for each k, the largest one not above its source's ratio is right.
    The table has a row for each source, and is read in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select(*sizes.columns, F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))
    )


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``i``: a Feistel network of four rounds on the next even number of bits; what leaves the range walks on."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(i, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r) & 0xFFFFFFFFFFFF)) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def running(df: DataFrame, value: str, name: str, per_chunk: int = 1024) -> DataFrame:
    """``df`` (s, shard, ..) with ``name``: the sum of ``value`` over the source's smaller shards. Two steps, within chunks of shards and over the chunks' sums, so no source's shards are all in one task."""
    df = df.withColumn("__chunk", F.floor(F.col("shard") / per_chunk))
    inside = Window.partitionBy("s", "__chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("s").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("s", "__chunk").agg(F.sum(value).alias("__sum")).select("s", "__chunk", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.withColumn("__within", within).join(sums, ["s", "__chunk"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__chunk", "__within", "__before")


def transfers(drawn: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(giver, first, end, taker): which of a source's surplus slots, by number, go to which source that has too few; givers and takers in order."""
    surplus = np.maximum(drawn - wanted, 0)
    out, take, left = [], 0, np.maximum(wanted - drawn, 0).tolist()
    for giver in np.flatnonzero(surplus).tolist():
        at = 0
        while at < surplus[giver]:
            while not left[take]:
                take += 1
            n = min(int(surplus[giver]) - at, left[take])
            out.append((giver, at, at + n, take))
            at, left[take] = at + n, left[take] - n
    return out


def draw_counts(spark: SparkSession, slots: np.ndarray, weights: np.ndarray, seed: int, size: int = SLOTS_PER_SHARD) -> DataFrame:
    """(s, shard, n): how many slots each source (by number) has in each output shard of ``size`` slots (the last one: what is left).

    Each shard's counts are a multinomial draw with the targets as weights, from a seed of the shard's own. The draws' totals differ from the
    sources' exact ``slots`` by about their square root; then the sources that were drawn too often give slots, spread over all shards in proportion to what
    these drew, to those drawn too seldom. So totals are exact, and each shard keeps its size.
    """
    total = int(slots.sum())
    shards = -(-total // size)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = weights / weights.sum()
        for frame in frames:
            for k in frame["id"].tolist():
                n = np.random.default_rng([seed, k]).multinomial(min(size, total - k * size), p)
                s = np.flatnonzero(n)
                yield pd.DataFrame({"s": s, "shard": np.full(len(s), k), "n": n[s]})

    drawn = checkpointed(spark.range(shards).mapInPandas(draw, "s long, shard long, n long"))
    totals = np.zeros(len(slots), np.int64)
    for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect():
        totals[r["s"]] = r["n"]
    moves = transfers(totals, slots)
    if not moves:
        return drawn
    surplus = {g: int(totals[g] - slots[g]) for g, *_ in moves}
    given = spark.createDataFrame([(g, int(totals[g]), surplus[g]) for g in surplus], "s long, total long, surplus long")
    to = spark.createDataFrame(moves, "s long, first long, end long, taker long")
    # A shard with the draws from a to b of a source's total gives its surplus slots from a x surplus / total to b x surplus / total.
    share = lambda c: F.floor(c.cast("decimal(38,0)") * F.col("surplus") / F.col("total")).cast("long")
    givers = running(drawn, "n", "before").join(F.broadcast(given), "s").select("s", "shard", share(F.col("before")).alias("a"), share(F.col("before") + F.col("n")).alias("b")).where("a < b")
    moved = givers.join(F.broadcast(to), "s").withColumn("m", F.least("b", "end") - F.greatest("a", "first")).where("m > 0")
    changes = moved.select("s", "shard", (-F.col("m")).alias("n")).unionByName(moved.select(F.col("taker").alias("s"), "shard", F.col("m").alias("n")))
    return drawn.unionByName(changes).groupBy("s", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def draw_slots(counts: DataFrame, sources: list[tuple[str | None, int]], block: int, seed: int, slots: int) -> DataFrame:
    """(s, shard, n) -> (s, shard, slot, index): the block that each slot of each output shard takes.

    A source's slots are numbered shard by shard; slot j takes block j mod n under the permutation of pass j div n. ``sources``: name and
    words of each source by number.
    """

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s, shard, first, n in zip(frame["s"], frame["shard"], frame["first"], frame["n"], strict=True):
                source, size = sources[s]
                name, blocks = crc(source) * 2 + (source is None), -(-size // block)
                j = np.arange(first, first + n)
                index = np.empty(len(j), np.int64)
                for turn in range(int(first) // blocks, int(j[-1]) // blocks + 1):
                    here = j // blocks == turn
                    index[here] = permute(j[here] % blocks, blocks, seed * 1_000_003 + name * 31 + turn)
                yield pd.DataFrame({"s": np.full(len(j), s), "shard": np.full(len(j), shard), "slot": j, "index": index})

    parts = max(1, min(10_000, slots // SLOTS_PER_TASK))
    return running(counts, "n", "first").repartition(parts, "s", "shard").mapInPandas(make, "s long, shard long, slot long, index long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 7, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``docs``, or these of its ``columns``, with ``size``, ``source_size``, ``target`` and ``taken``; the slots of the mix: source, shard, slot, index).

    The words of a source, in an order fixed by ids, are packed into blocks of ``block``. The mix is made of shards of SLOTS_PER_SHARD slots, a block each: how
    many slots a source has in a shard is drawn (``draw_counts``), and which blocks these take follows from a permutation for each source and
    pass (``draw_slots``). A source takes every block target div size times, and one time more as many blocks as make up the rest; no block is taken more than
    twice, as no target exceeds twice the size.  ``taken`` counts a document's words in the slots' blocks, repeats included.

    Rows are written once with their sizes and numbers, and everything else follows from that.
    Places in a source are prefix sums in two steps, within chunks of ids and over the chunks' sums, so that a source with
    a third of all rows is in no single task.  Sources are few enough (MOST_SOURCES) that a row for each fits the driver.

    Null text: size 0.  A long text is in as many blocks as it fills.  Null source: one source, last.  Null ids and repeated rows:
    each row is one document.  Ties of ids: in order of size.  Empty table or no words: no slots.  Columns named like the results are replaced.
    """
    spark = docs.sparkSession
    word = "[^\\x20\\x09-\\x0D]+"
    kept = docs.columns if columns is None else columns
    size = F.when(F.length(strip(F.col(text_col))) > 0, F.regexp_count(F.col(text_col), F.lit(word))).otherwise(0).cast("long")
    rows = checkpointed(docs.select(F.struct(*kept).alias(ALL), F.monotonically_increasing_id().alias(ROW), F.col(id_col).alias("id"), F.struct(F.col(source_col).cast("string").alias("source")).alias("name"), size.alias("size")))
    totals = rows.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = targets(totals.select("name.source", "source_size", "n")).orderBy(F.col("source").asc_nulls_last()).toPandas()
    sizes, goal = plan["source_size"].to_numpy(np.int64), plan["target"].to_numpy(float)
    names = [None if x is None or x != x else x for x in plan["source"].tolist()]
    blocks = -(-sizes // block)
    passes = np.minimum(np.floor(goal / np.maximum(sizes, 1)), 2).astype(np.int64)
    rest = np.maximum(goal - passes * sizes, 0.0)
    slots = np.minimum(passes * blocks + np.round(rest * blocks / np.maximum(sizes, 1)).astype(np.int64), 2 * blocks)
    counts = draw_counts(spark, slots, np.where(slots > 0, goal, 0.0), seed) if slots.sum() else spark.createDataFrame([], "s long, shard long, n long")
    drawn = draw_slots(counts, list(zip(names, sizes.tolist(), strict=True)), block, seed, int(slots.sum()))

    known = spark.createDataFrame([((x,), k, int(n), float(t)) for k, (x, n, t) in enumerate(zip(names, sizes, goal, strict=True))], "name struct<source: string>, s long, source_size long, target double")
    sized = rows.select(ROW, "id", "name", "size").join(F.broadcast(known), "name")
    chunks = max(1, -(-int(plan["n"].sum()) // ROWS_PER_CHUNK))
    dealt = sized.select(ROW, "id", "s", "size", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(chunks)).alias("chunk"))
    order = Window.partitionBy("chunk", "s").orderBy("id", "size", ROW).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.repartition("chunk").withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sums = dealt.groupBy("s", "chunk").agg(F.sum("size").alias("sum"))
    before = running(sums.select("s", F.col("chunk").alias("shard"), "sum"), "sum", "before").select("s", F.col("shard").alias("chunk"), "before")
    placed = inside.join(before, ["s", "chunk"]).select(ROW, "s", "size", (F.col("before") + F.col("within")).alias("first"))
    pieces = placed.where("size > 0").select(ROW, "s", "size", "first", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("index"))
    overlap = F.least(F.col("first") + F.col("size"), (F.col("index") + 1) * block) - F.greatest("first", F.col("index") * block)
    times = drawn.groupBy("s", "index").agg(F.count("*").alias("times"))
    # Spark takes the slots for as few as the shards that they are made from; the hint keeps it from broadcasting them.
    taken = pieces.join(times.hint("merge"), ["s", "index"]).groupBy(F.col(ROW).alias("r")).agg(F.sum(overlap * F.col("times")).alias("taken"))
    mixed = rows.join(F.broadcast(known), "name").join(taken, F.col(ROW) == F.col("r"), "left")
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.coalesce("taken", F.lit(0))}
    out = {n.lower() for n in new}
    return mixed.select(*[F.col(ALL)[c].alias(c) for c in kept if c.lower() not in out], *[c.alias(n) for n, c in new.items()]), drawn.join(F.broadcast(known.select("s", "name.source")), "s").select("source", "shard", "slot", "index")


def query(docs: DataFrame) -> DataFrame:
    return mix_sources(docs, columns=["doc_id"])[0].select("doc_id", "size", "source_size", "target", "taken")
