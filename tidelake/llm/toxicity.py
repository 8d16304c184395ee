"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, IS_ALNUM, checkpointed, hash_fold, numbered, runs, sampled, span_hashes, strings_array, text_batches

#: Rows to learn from, at most about so many; chosen by a hash of the id.
SAMPLE = 40_000
#: Hashed tokens: so many buckets, whatever the corpus; the tables of counts have this size.
BUCKETS = 1 << 20
#: A word's token, and its beginnings of so many bytes, shorter ones first.
STEMS = (2, 3, 4, 5, 6, 7, 8, 10, 12)
#: Weight of the prior of each token, which is centred on its beginning's odds.
PRIOR = 10.0
#: Taken from each word's log-odds, so that a segment of ordinary words loses.
DRIFT = 0.6
FOLDS = 5
#: Scores above this count in a text's sum.
FAIR = 2.0
#: Where the scale of the extreme-value distribution is looked for.
SCALES = np.arange(0.05, 4.0, 0.05)


class Model(NamedTuple):
    #: Share of class 1 among the evidence, and the amount of evidence, by bucket.
    ones: np.ndarray
    zeros: np.ndarray
    #: Of the extreme-value distribution of the highest segment in a clean text, then of the logistic curve.
    scale: float = 1.0
    constant: float = 1.0
    weights: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0)
    #: Share of class 1: the score of a text without words.
    prior: float = 0.0


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of [0-9A-Za-z] and non-ASCII in ``data``, and the text of each; ``ends`` are the texts' ends, a separator is before each."""
    s, e = runs(IS_ALNUM[data])
    return s, e, np.searchsorted(ends, s, side="right")


def different(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words: each one's number among the different ones, these in one array (folded), where they begin and end."""
    number, found = numbered(strings_array(FOLD[data[IS_ALNUM[data]]], e - s))
    edges = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
    return number, np.frombuffer(found.buffers()[2] or b"", np.uint8), edges[:-1], edges[1:]


def tokens(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[np.ndarray]:
    """Of folded words: buckets of each word's beginnings, then of the whole word; a beginning that is the whole word or longer counts as the one before it, so -1."""
    for n, stem in enumerate((*STEMS, 1 << 40)):
        end = np.minimum(s + stem, e)
        h = span_hashes(data, s, end) + np.uint64(0x632BE59BD9B4E019 * (stem >= 1 << 40) & (1 << 64) - 1)
        b = (h % np.uint64(BUCKETS)).astype(np.int64)
        if n and stem < 1 << 40:
            b[e - s <= STEMS[n - 1]] = -1
        yield b


def log_odds(model: Model, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of each word: Beta (two-class Dirichlet) posteriors down its chain of beginnings, each the prior mean of the next. Different words are looked at once."""
    number, text, first, end = different(data, s, e)
    share = np.full(len(first), 0.5)
    for b in tokens(text, first, end):
        one, zero = model.ones[b], model.zeros[b]
        share = np.where(b < 0, share, (one + PRIOR * share) / (one + zero + PRIOR))
    return (np.log(share) - np.log1p(-share) - DRIFT)[number]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in linear time, after Ruzzo and Tompa (1999).

    Runs of one sign are merged first: a maximal segment begins and ends with whole runs of positive scores.
    """
    starts, ends = runs(scores > 0)
    if not len(starts):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, the last one to the left with a lower sum before
    for a, b, left, right in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist(), strict=True):
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            a, left, up = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = up
        stack.append((a, b, left, right, j))
    return [(x[0], x[1], x[3] - x[2]) for x in stack]


def measured(model: Model, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Of each text: its number of words, and its segments."""
    data, ends = joined(texts)
    s, e, doc = words(data, ends)
    scores = log_odds(model, data, s, e)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(b - a), segments(scores[a:b])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, a space after each, and the ends with that space."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return data, np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))


def evidence(model: Model, n: int, scores: list[float]) -> list[float]:
    """Of a text of n words with segments of these scores: 1, the highest one's excess over chance, ln of the sum of all excesses, ln of the sum of the scores above FAIR, ln n.

    A clean text of n words has about constant x n x exp(-scale x score) segments as high as a score (Karlin and Altschul).
    """
    chance = np.log(model.constant * max(n, 1))
    excess = [model.scale * x - chance for x in scores]
    return [1.0, max(-20.0, min(max(excess, default=-chance), 50.0)), float(np.log1p(sum(x for x in excess if x > 0))), float(np.log1p(sum(x for x in scores if x > FAIR))), float(np.log(max(n, 1)))]


def probability(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    if not n:
        return model.prior
    x = float(np.dot(model.weights, evidence(model, n, [y[2] for y in found])))
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, text, label) of about ``sample`` labelled rows of the training folds; the labels kept are few enough to be broadcast."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(hash_fold(id_col, FOLDS) != 0).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).cast("int").alias("label"))
    n = known.count()
    known = known.where(sampled("id", sample / max(n, 1)))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample of labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    Fold 4 is for calibration, the others give the counts.  The sample is written once.  Token counts are summed by bucket and class on the
    executors, the driver gets two tables of BUCKETS numbers at most.

    Null ids, labels and texts teach nothing. Several labels of one id: 1 if one of them is. Repeated rows: each is a text. Labels of one class
    only, or none: the curve stays as it is at first, and scores aren't calibrated.
    """
    rows = checkpointed(_sampled(docs, labels, id_col, text_col, label_col, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS))
        for batch in batches:
            label = np.array(batch.column("label").to_pylist())
            for a, b, texts in text_batches(batch, "text"):
                data, ends = joined(texts)
                s, e, doc = words(data, ends)
                number, text, first, end = different(data, s, e)
                n = [np.bincount(number[label[a:b][doc] == k], minlength=len(first)) for k in (0, 1)]
                for t in tokens(text, first, end):
                    for k in (0, 1):
                        sums[k] += np.bincount(t[t >= 0], weights=n[k][t >= 0], minlength=BUCKETS)
        for k in (0, 1):
            at = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(sums[k][at])], ["label", "bucket", "n"])

    got = rows.where(hash_fold("id", FOLDS) != FOLDS - 1).select("text", "label").mapInArrow(count, "label int, bucket long, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((2, BUCKETS))
    sums[got["label"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    total = sums.sum(axis=1)
    # Class 0 counts as much as class 1 in all, so that odds of 1 are no evidence.
    model = Model(sums[1].astype(np.float32), (sums[0] * (total[1] / max(total[0], 1.0))).astype(np.float32))
    return calibrate(model, rows.where(hash_fold("id", FOLDS) == FOLDS - 1).select("text", "label"))


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Scale and place of the extreme-value distribution from clean texts, then the curve over the evidence in all: two passes, of whose texts a few numbers each come to the driver."""

    def over(model: Model, f, schema: str, types: list[pa.DataType]):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = batch.column("label").to_pylist()
                for a, b, texts in text_batches(batch, "text"):
                    got = f(shared.value, np.array(label[a:b]), texts)
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate(types)], ["label", "n", "x"])

        return rows.mapInArrow(measure, schema).toArrow().to_pandas()

    def place(m: Model, own: np.ndarray, texts: list[bytes]) -> list:
        data, ends = joined(texts)
        s, e, doc = words(data, ends)
        clean = log_odds(m, data, s, e)[own[doc] == 0]
        got = [(int(y), n, [max((x[2] for x in found), default=0.0)]) for y, (n, found) in zip(own, measured(m, texts), strict=True)]
        return [*got, (-1, len(clean), [float(np.exp(x * clean).sum()) for x in SCALES])]

    def features(m: Model, own: np.ndarray, texts: list[bytes]) -> list:
        return [(int(y), n, evidence(m, n, [x[2] for x in found])) for y, (n, found) in zip(own, measured(m, texts), strict=True)]

    layout = ("label int, n long, x array<double>", [pa.int32(), pa.int64(), pa.list_(pa.float64())])
    got = over(model, place, *layout)
    sums, clean = got[got["label"] < 0], got[(got["label"] == 0) & (got["n"] > 0)]
    if len(clean):
        # The scale is the root of E[exp(scale x score)] = 1 over clean words; the place is the median of a Gumbel distribution.
        scale = float(SCALES[np.abs(np.log(np.stack(sums["x"]).sum(axis=0) / sums["n"].sum())).argmin()])
        top = np.concatenate(clean["x"].to_numpy()) - np.log(clean["n"].to_numpy()) / scale
        model = model._replace(scale=scale, constant=float(np.exp(scale * np.median(top) + np.log(np.log(2)))))
    got = over(model, features, *layout)
    got = got[got["n"] > 0]
    if got["label"].nunique() == 2:
        x, y = np.stack(got["x"]), got["label"].to_numpy(float)
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.01
            w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.01 * w), -5, 5)
        model = model._replace(weights=tuple(w), prior=float(y.mean()))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_words, passages): the probability of class 1, and every significant passage with its first and last word (by number) and its score.

    A map over rows; the model has a fixed size and is broadcast.  Null or empty text: no words, no passages, the share of class 1
    as score.  Texts are scored whole, however long.  Null ids and repeated rows pass through.  Ties: equal texts, equal scores.  Empty table: no rows.
    Other columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, texts in text_batches(batch, 1):
                got = list(measured(m, texts))
                chance = [np.log(m.constant * max(n, 1)) for n, _ in got]
                passages = [[{"first": x[0], "last": x[1] - 1, "score": x[2]} for x in found if m.scale * x[2] > c] for (_, found), c in zip(got, chance, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([probability(m, *x) for x in got], pa.float64()), pa.array([x[0] for x in got], pa.int64()), pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))],
                    ["id", "score", "n_words", "passages"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(score, f"id {kind.simpleString()}, score double, n_words long, passages array<struct<first: bigint, last: bigint, score: double>>")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = score_documents(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        (hash_fold("id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
