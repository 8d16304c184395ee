"""Language ID by prediction by partial matching with frozen byte models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hash_bound, hash_fold, mix64, text_batches

#: Bytes of context at most.
ORDER = 4
#: Texts to learn from for each language, at most about so many; chosen by a hash of the id.
SAMPLE = 400
#: Languages that are learnt, the most frequent labels: a dirty column can't fill the driver.
LANGUAGES = 256
FOLDS = 5
#: What a text's start looks like.
START = b"\n" * ORDER
#: Bits by which the best language has to win per this many, for the score's odds.
SHARPNESS = 0.25


class Table(NamedTuple):
    """A hash table with open addressing: keys (0: free) and the rows that they have."""

    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        bits = max(4, int(len(keys) * 2).bit_length())
        table = cls(np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32))
        todo, at = np.arange(len(keys)), (mix64(keys) >> np.uint64(64 - bits)).astype(np.int64)
        while len(todo):
            free = table.keys[at] == 0
            table.keys[at[free]] = keys[todo[free]]  # of several that want a place, one gets it
            mine = free & (table.keys[at] == keys[todo])
            table.rows[at[mine]] = todo[mine]
            todo, at = todo[~mine], (at[~mine] + 1) & ((1 << bits) - 1)
        return table

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it has none."""
        bits = len(self.keys).bit_length() - 1
        at = (mix64(keys) >> np.uint64(64 - bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.rows[at], -1)
        todo = np.flatnonzero((there != keys) & (there != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << bits) - 1)
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            more = ~hit & (there != 0)
            todo, at = todo[more], at[more]
        return out


class Model(NamedTuple):
    languages: list[str]
    #: By order 0 to ORDER: strings (context and byte) and the bits that each language takes for the byte in it.
    strings: list[Table]
    bits: list[np.ndarray]
    #: By order 0 to ORDER: contexts and the bits that each language takes to escape from it (0: it hasn't seen it).
    contexts: list[Table]
    escapes: list[np.ndarray]


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes up to each place from n - 1 on, as numbers with a bit above, so that lengths differ and none is 0."""
    out = np.full(max(0, len(data) - n + 1), 1, np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[k : len(data) - n + 1 + k]
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, START before each, and the places where the texts begin."""
    sizes = np.array([len(t) + ORDER for t in texts], np.int64)
    return np.frombuffer(START + START.join(texts), np.uint8), np.cumsum(sizes) - sizes + ORDER


def build(counts: list[tuple[str, int, int]]) -> Model:
    """From (language, string of ORDER + 1 bytes as a number, count): every table, each order's counts being sums over the longest strings."""
    languages = sorted({x[0] for x in counts})
    number = {x: k for k, x in enumerate(languages)}
    lang = np.array([number[x[0]] for x in counts], np.int64)
    full = np.array([x[1] for x in counts], np.uint64)
    n = np.array([x[2] for x in counts], np.float64)
    width = len(languages)
    model = Model(languages, [], [], [], [])
    lower = np.full((1, width), 8.0)
    for k in range(ORDER + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        top = np.uint64(1 << 8 * (k + 1))
        keys, at = np.unique((full & mask) | top, return_inverse=True)
        count = np.zeros((len(keys), width))
        np.add.at(count, (at, lang), n)
        ctx = ((keys & mask) >> np.uint64(8)) | np.uint64(1 << 8 * k)
        own, where = np.unique(ctx, return_inverse=True)
        total, kinds = np.zeros((len(own), width)), np.zeros((len(own), width))
        np.add.at(total, where, count)
        np.add.at(kinds, where, count > 0)
        # Method C: a context with d different bytes in n escapes with probability d / (n + d).
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(count / (total + kinds)[where])
        if k:
            shorter = model.strings[k - 1].find((keys & (mask >> np.uint64(8))) | np.uint64(1 << 8 * k))
            lower = model.bits[k - 1][shorter]
        bits = np.where(count > 0, direct, escape[where] + lower)
        model.strings.append(Table.of(keys))
        model.bits.append(bits.astype(np.float32))
        model.contexts.append(Table.of(own))
        model.escapes.append(escape.astype(np.float32))
    return model


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits that each language takes for each text: sums of -log2 of the byte's probability in its longest known context, escapes included."""
    data, starts = joined(texts)
    out = np.zeros((len(texts), len(model.languages)))
    sizes = np.array([len(t) for t in texts], np.int64)
    full = grams(data, ORDER + 1)  # the string that ends at place i + ORDER
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(int(sizes.sum())) + np.repeat(starts - ORDER - (np.cumsum(sizes) - sizes), sizes)
    keys = full[place]
    for k in range(ORDER, -1, -1):
        if not len(keys):
            break
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own = keys & mask
        row = model.strings[k].find(own | np.uint64(1 << 8 * (k + 1)))
        hit = row >= 0
        _add(out, owner[hit], model.bits[k], row[hit])
        keys, owner, own = keys[~hit], owner[~hit], own[~hit]
        ctx = model.contexts[k].find((own >> np.uint64(8)) | np.uint64(1 << 8 * k))
        known = ctx >= 0
        _add(out, owner[known], model.escapes[k], ctx[known])
    out += 8.0 * np.bincount(owner, minlength=len(texts))[:, None]  # bytes that no language has seen
    return out


def _add(out: np.ndarray, owner: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    for j in range(out.shape[1]):
        out[:, j] += np.bincount(owner, weights=table[rows, j], minlength=len(out))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learn from about ``sample`` texts of each of the ``languages`` most frequent labels (ties: by name) outside the held-out fold; strings are counted on the executors.

    What comes to the driver are the labels' counts and the different strings of ORDER + 1 bytes in the sample, whose sizes don't depend on the corpus.
    Null texts, labels and empty tables: nothing to learn; a model without languages calls every text 'und'.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(hash_fold(id_col, FOLDS) != 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model([], [], [], [], [])
    bounds = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, (1 << 63) - 1 if hash_bound(sample / n) is None else hash_bound(sample / n))])
    rows = rows.where(F.xxhash64(id_col) <= bounds[F.col(lang_col)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in text_batches(batch, 1):
                for lang in set(langs[a:b]):
                    own = [t for t, x in zip(texts, langs[a:b], strict=True) if x == lang]
                    data, starts = joined(own)
                    last = np.ones(len(data), bool)
                    for k in range(ORDER):
                        last[starts - 1 - k] = False
                    keys, n = np.unique(grams(data, ORDER + 1)[last[ORDER:]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array((keys & np.uint64((1 << 8 * (ORDER + 1)) - 1)).astype(np.int64)), pa.array(n)], ["lang", "string", "n"])

    got = rows.select(F.col(lang_col), F.col(text_col)).mapInArrow(count, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return build(list(zip(got["lang"], got["string"], got["n"], strict=True))) if len(got) else Model([], [], [], [], [])


def predict(model: Model, texts: list[bytes]) -> list[tuple[str, float, float]]:
    """Of each text: the language ('und' without a letter), the score, bits a byte (of the best language)."""
    if not model.languages:
        return [("und", 0.0, 8.0)] * len(texts)
    bits = code_lengths(model, texts)
    out = []
    for t, row in zip(texts, bits, strict=True):
        if not any(map(str.isalpha, t.decode("utf-8", "replace"))):
            out.append(("und", 0.0, 8.0))
            continue
        best = int(row.argmin())
        share = 1 / np.exp2(-np.minimum((row - row[best]) * SHARPNESS, 1000)).sum()
        out.append((model.languages[best], float(share), float(row[best] / len(t))))
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``bits_per_byte`` added.

    A map over rows with the frozen model, whose size the sample bounds.  Texts are scored whole, however long.  Null text or no letter: 'und', score 0.  Ties: the first
    language by name.  Null ids and repeated rows pass through.  Empty table: no rows.  Columns named like the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [("lang_pred", "string", pa.string()), ("lang_score", "double", pa.float64()), ("bits_per_byte", "double", pa.float64())]
    kept = [c for c in docs.columns if c.lower() not in {n for n, _, _ in new}]
    at = next(k for k, c in enumerate(kept) if c.lower() == text_col.lower())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_batches(batch, at, 1 << 20):
                rows = predict(shared.value, texts)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], *[pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(new)]], [*kept, *[n for n, _, _ in new]])

    frame = docs.select(*kept)
    schema = StructType(list(frame.schema.fields))
    for n, t, _ in new:
        schema = schema.add(n, t)
    return frame.mapInArrow(score, schema)


def query(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (hash_fold("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte")
