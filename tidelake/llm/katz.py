"""Language-model scores by Katz backoff over tables of bigram counts that are dealt out by hash."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, IS_SPACE, ROW, bundle, checkpointed, hash_fold, mix64, numbered, pack_ints, pack_strings, release, runs, span_hashes, strings_array, text_batches, unbundle, unpack_ints, unpack_strings

FOLDS, HELD_OUT = 7, 2
#: Counts up to this are discounted.
K = 5
#: Bytes of text in a block, and tokens of the corpus for each part of a table.
BLOCK_BYTES, PART_TOKENS, LEAST_PARTS = 12 << 20, 4_000_000, 48
#: The end of a text as a word; no word has a space.
END = b" "
MESSAGE = "key long, block long, kind int, payload binary, stats array<double>"
TEXT, WORDS, COUNTS, CONTEXTS, STATS, WEIGHTS = range(6)


class Block(NamedTuple):
    """Texts of one part of the corpus: tokens in each, whether it is for training, numbers of the tokens (words by falling frequency, which compresses), and each word's place among the block's words as they are dealt out."""

    sizes: np.ndarray
    train: np.ndarray
    tokens: np.ndarray
    place: np.ndarray

    def pack(self) -> bytes:
        return bundle(pack_ints(self.sizes), pack_ints(self.train), pack_ints(self.tokens), pack_ints(self.place))

    @classmethod
    def unpack(cls, b: bytes) -> Block:
        sizes, train, tokens, place = map(unpack_ints, unbundle(b))
        return cls(sizes.astype(np.int64), train.astype(bool), tokens.astype(np.int64), place.astype(np.int64))

    def trained(self) -> np.ndarray:
        """Whether each token is for training."""
        return np.repeat(self.train, self.sizes)

    def contexts(self) -> np.ndarray:
        """The number of the token before each; of a first one, the number after all words'."""
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = len(self.place)
        return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes by which words are dealt out; what they are is decided on their bytes."""
    edges = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    return span_hashes(np.frombuffer(words.buffers()[2] or b"", np.uint8), edges[:-1], edges[1:])


def read_block(texts: list[bytes], train: np.ndarray) -> tuple[Block, pa.Array]:
    """A block, and its different words (compared byte by byte) in order of their hashes."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    word = ~IS_SPACE[data]
    s, e = runs(word)
    number, words = numbered(strings_array(FOLD[data[word]], e - s))
    doc = np.searchsorted(ends, s, side="right")
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    tokens = np.full(int(sizes.sum()), len(words), np.int64)
    tokens[np.arange(len(s)) + doc] = number
    words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
    by_count = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by_count] = np.arange(len(words))
    dealt = np.argsort(word_hashes(words), kind="stable")
    place = np.empty(len(words), np.int64)
    place[dealt] = np.arange(len(words))
    return Block(sizes, train, rank[tokens], place[by_count]), words.take(pa.array(dealt))


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """d_0 .. d_k of Good-Turing from the counts of counts n[0..k+1] (n[0] unused); 1 where they can't be had or aren't within (0, 1]."""
    d = np.ones(k + 1)
    if n[1] <= 0:
        return d
    tail = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        if n[r] > 0 and tail < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
            d[r] = x if 0 < x <= 1 else 1.0
    return d


class Unigrams(NamedTuple):
    """N, V, d_0 .. d_k, the mass of unseen words, and what the seen ones' discounted shares are multiplied with so that all sum up to 1."""

    total: int
    kinds: int
    d: np.ndarray
    unseen: float
    scale: float

    @classmethod
    def of(cls, total: float, kinds: float, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        lost = sum((1 - d[r]) * r * n[r] for r in range(1, K + 1))
        unseen = lost / total if total and lost > 0 else 1 / (total + 1)
        return cls(int(total), int(kinds), d, unseen, (1 - unseen) / (1 - lost / total) if total else 0.0)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d[np.minimum(c, K) * (c <= K)] * c / max(self.total, 1), self.unseen)


def counts_of_counts(c: np.ndarray) -> list[float]:
    return np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2)[: K + 2].astype(float).tolist()


def rows(items: list[tuple[int, int, int, bytes | None, list[float] | None]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in items], t) for i, t in enumerate(types)], ["key", "block", "kind", "payload", "stats"])


def by_part(parts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and the places where it does, in order."""
    order = np.argsort(parts, kind="stable")
    edges = np.searchsorted(parts[order], np.arange(n + 1))
    for p in range(n) if n < len(parts) else np.unique(parts).tolist():
        if edges[p + 1] > edges[p]:
            yield p, order[edges[p] : edges[p + 1]]


def word_parts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Parts by range of hash: a block's words in order of hash are in order of part, and so are the answers."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def in_order(answers: dict[int, list[np.ndarray]], block: Block) -> list[np.ndarray]:
    """Arrays by word number out of the parts' answers."""
    return [np.concatenate(x)[block.place] for x in zip(*[answers[p] for p in sorted(answers)], strict=True)]


def _asked(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """For each block and part of the words' table: the words and their training counts."""
    for batch in batches:
        for number, payload, packed in zip(*[batch.column(c).to_pylist() for c in ("block", "payload", "words")], strict=True):
            b, words = Block.unpack(payload), unpack_strings(packed)
            c = np.empty(len(words), np.int64)
            c[b.place] = np.bincount(b.tokens[b.trained()], minlength=len(words))
            yield rows([(p, number, WORDS, bundle(pack_strings(words.slice(at[0], len(at))), pack_ints(c[at])), None) for p, at in by_part(word_parts(word_hashes(words), n), n)])


def _words(table: pa.Table, n: int) -> pa.Table:
    """One part of the words' table: sums of counts, then an answer for each block with ids (by falling count) and counts, and the part's statistics."""
    part, blocks = table.column("key")[0].as_py(), table.column("block").to_pylist()
    asked = [(unpack_strings(x), unpack_ints(c)) for x, c in map(unbundle, table.column("payload").to_pylist())]
    at, words = numbered(pa.concat_arrays([x[0] for x in asked]))
    c = np.bincount(at, weights=np.concatenate([x[1] for x in asked]).astype(np.float64), minlength=len(words)).astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(words))
    ids = rank * n + part + 1
    out, i = [], 0
    for b, (h, _) in zip(blocks, asked, strict=True):
        own = at[i : i + len(h)]
        i += len(h)
        out.append((part, b, WORDS, bundle(pack_ints(ids[own]), pack_ints(c[own])), None))
    out.append((part, -1, STATS, None, [float(c.sum()), float((c > 0).sum()), *counts_of_counts(c)]))
    return pa.Table.from_batches([rows(out)])


class Known(NamedTuple):
    """A block, what it has been told of its words, and its different bigrams: numbers of context and word, and the bigram of each token."""

    block: Block
    ids: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    words: np.ndarray
    bigram: np.ndarray

    @classmethod
    def of(cls, block: Block, answers: dict[int, bytes], n: int) -> Known:
        ids, counts = in_order({p: [x.astype(np.int64) for x in map(unpack_ints, unbundle(a))] for p, a in answers.items()}, block)
        # The number after all words' is the context of first words: id 0, never asked about.
        ids, counts, width = np.append(ids, 0), np.append(counts, 1), len(block.place) + 1
        pairs, bigram = np.unique(block.contexts() * width + block.tokens, return_inverse=True)
        return cls(block, ids, counts, pairs // width, pairs % width, bigram)

    def requests(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Parts of the bigrams' table and the bigrams to ask there for, by id; those of words that training lacks have no counts anyway."""
        at = np.flatnonzero((self.counts[self.contexts] > 0) & (self.counts[self.words] > 0))
        x, y = self.ids[self.contexts[at]].astype(np.uint64), self.ids[self.words[at]].astype(np.uint64)
        at = at[np.lexsort((y, x))]
        x, y = self.ids[self.contexts[at]].astype(np.uint64), self.ids[self.words[at]].astype(np.uint64)
        for p, own in by_part((pair_hash(x, y) % np.uint64(n)).astype(np.int64), n):
            yield p, at[own]


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(mix64(x) + y)


def _pairs(table: pa.Table, n: int) -> pa.Table:
    """For each part of the bigrams' table: ids of context and word, training counts in the block, the word's count in all."""
    b, answers = None, {}
    for key, kind, payload in zip(*[table.column(c).to_pylist() for c in ("key", "kind", "payload")], strict=True):
        if kind == TEXT:
            b = Block.unpack(payload)
        else:
            answers[key] = payload
    k, number = Known.of(b, answers, n), table.column("block")[0].as_py()
    c = np.bincount(k.bigram[b.trained()], minlength=len(k.contexts))
    out = []
    for p, at in k.requests(n):
        out.append((p, number, COUNTS, bundle(pack_ints(k.ids[k.contexts[at]], True), pack_ints(k.ids[k.words[at]]), pack_ints(c[at]), pack_ints(np.where(c[at] > 0, k.counts[k.words[at]], 0))), None))
    return pa.Table.from_batches([rows(out)])


def _bigrams(table: pa.Table, n: int, uni: Unigrams) -> pa.Table:
    """One part of the bigrams' table: sums of counts and the answers to blocks; for each context, how many of its bigrams occur once, twice, .. K times and the sum of their words' own probabilities."""
    part, blocks = table.column("key")[0].as_py(), table.column("block").to_pylist()
    asked = [tuple(map(unpack_ints, unbundle(p))) for p in table.column("payload").to_pylist()]
    x, y, own, word = (np.concatenate([a[i] for a in asked]) for i in range(4))
    _, first, at = np.unique(pair_hash(x, y), return_index=True, return_inverse=True)
    c = np.bincount(at, weights=own.astype(np.float64), minlength=len(first)).astype(np.int64)
    total = np.zeros(len(first), np.int64)
    np.maximum.at(total, at, word.astype(np.int64))
    out, i = [], 0
    for b, a in zip(blocks, asked, strict=True):
        out.append((part, b, COUNTS, pack_ints(c[at[i : i + len(a[0])]]), None))
        i += len(a[0])
    seen = c > 0
    contexts, where = np.unique(x[first][seen], return_inverse=True)
    many = np.zeros((len(contexts), K + 1), np.int64)
    np.add.at(many, (where, np.where(c[seen] <= K, c[seen], 0)), 1)
    mass = np.bincount(where, weights=uni.probability(total[seen]), minlength=len(contexts))
    for p, own_ in by_part(((contexts.astype(np.int64) - 1) % n).astype(np.int64), n):
        out.append((p, -1, CONTEXTS, bundle(pack_ints(contexts[own_], True), *[pack_ints(many[own_, r]) for r in range(1, K + 1)], mass[own_].tobytes()), None))
    out.append((part, -1, STATS, None, counts_of_counts(c)))
    return pa.Table.from_batches([rows(out)])


def backoff(d: np.ndarray, many: np.ndarray, mass: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: the weight of the shorter model for unseen words, and what seen words' discounted shares are multiplied with.

    What discounting frees, over the shorter model's mass of the words not seen. A context that frees nothing gives 1 / (count + 1).
    """
    freed = (many * ((1 - d[1:]) * np.arange(1, K + 1))).sum(axis=1) / np.maximum(count, 1)
    left = np.where(freed > 0, freed, 1 / (count + 1))
    return left / np.maximum(1 - mass, 1e-300), (1 - left) / (1 - freed)


def _weights(table: pa.Table, n: int, d: np.ndarray, starts: int) -> pa.Table:
    """One part of the contexts' table: sums over the parts of bigrams, then each block's words' weights (key: part)."""
    part = table.column("key")[0].as_py()
    told, answers = [], []
    for number, kind, payload in zip(*[table.column(c).to_pylist() for c in ("block", "kind", "payload")], strict=True):
        pieces = unbundle(payload)
        if kind == CONTEXTS:
            told.append((unpack_ints(pieces[0]).astype(np.int64), np.stack([unpack_ints(p) for p in pieces[1 : K + 1]], axis=1).astype(np.int64), np.frombuffer(pieces[K + 1])))
        else:
            answers.append((number, *[unpack_ints(p).astype(np.int64) for p in pieces]))
    ids = np.concatenate([t[0] for t in told] or [np.zeros(0, np.int64)])
    ranks = (ids - 1) // n
    size = max([int(ranks.max(initial=-1)) + 1, *[int(a.max(initial=0) - 1) // n + 1 for _, a, _ in answers]])
    many, mass = np.zeros((size + 1, K), np.int64), np.zeros(size + 1)
    for (i, m, s) in told:
        r = np.where(i > 0, (i - 1) // n, size)  # the last row is for the context of first words
        np.add.at(many, r, m)
        np.add.at(mass, r, s)
    out = []
    for number, a, c in answers:
        r = (a - 1) // n
        weight, scale = backoff(d, many[r], mass[r], c)
        out.append((part, number, WEIGHTS, bundle(np.where(c > 0, weight, 1.0).tobytes(), np.where(c > 0, scale, 1.0).tobytes()), None))
    if (ids == 0).any():
        weight, scale = backoff(d, many[-1:], mass[-1:], np.array([starts]))
        out.append((part, -1, STATS, None, [float(weight[0]), float(scale[0])]))
    return pa.Table.from_batches([rows(out)])


def score_block(k: Known, answers: dict[int, bytes], weights: dict[int, bytes], n: int, uni: Unigrams, d: np.ndarray, starts: int, first: tuple[float, float]) -> dict[str, np.ndarray]:
    """Of each text: tokens, known ones, base score and the model's.  ``starts`` and ``first``: count and weights of the context of first words."""
    b = k.block
    weight, scale = in_order({p: [np.frombuffer(x) for x in unbundle(a)] for p, a in weights.items()}, b)
    weight, scale = np.append(weight, first[0]), np.append(scale, first[1])
    c = np.zeros(len(k.contexts), np.int64)
    for p, at in k.requests(n):
        c[at] = unpack_ints(answers[p]).astype(np.int64)
    lower = uni.probability(k.counts[k.words])
    seen, total = c > 0, np.where(k.contexts == len(b.place), starts, k.counts[k.contexts])
    p2 = np.where(seen, scale[k.contexts] * d[np.minimum(c, K) * (c <= K)] * c / np.maximum(total, 1), weight[k.contexts] * lower)
    logs = np.log10(p2)[k.bigram]
    base = np.log10((k.counts[:-1] + 1) / (uni.total + uni.kinds + 1))[b.tokens]
    at = np.cumsum(b.sizes) - b.sizes
    return {"n_tokens": b.sizes, "n_known": np.add.reduceat((k.counts[b.tokens] > 0).astype(np.int64), at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at)}


def _sums(df: DataFrame) -> list[float]:
    """Sums of the statistics over all parts."""
    got = df.where(F.col("kind") == STATS).select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return [x["x"] for x in sorted(got, key=lambda x: x["i"])]


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``train`` is true are learnt from.

    Blocks of texts are tokenised once, as numbers of the block's different words, and written. Words are compared by their bytes, hashes only
    deal them out; bigrams are pairs of the words' numbers. Tables of words, bigrams and contexts
    are dealt out by hash over parts whose number follows the corpus; what a block needs of a part, and what it knows, is one packed message,
    and so is the answer. A frequent word or context is in many messages but is one number in each, bigrams are dealt out
    by context and word, and a context's sums meet in partial form: no key gathers rows.

    P(w | v) is the discounted share of the bigram if training has it, else weight(v) x P(w); P(w) in turn is the discounted share of the
    word if training has it, else what discounts have left over, for one unknown word. Weights normalise exactly over the
    V + 1 words.

    Null text: as empty, so one token, the end. A long text is in one block, however long. Null ids pass through. Repeated rows: each is a text. Ties
    (words of one count) get their numbers in any order, which no result shows. Empty table: no rows. No text to
    learn from: every token is unknown and certain. Other columns are left out, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias(ROW), F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in text_batches(batch, 3, BLOCK_BYTES):
                block, words = read_block(own, np.array(batch.column(2).slice(a, b - a).to_pylist(), bool))
                ids = pa.ListArray.from_arrays([0, b - a], batch.column(1).slice(a, b - a))
                n = [float(len(block.tokens)), float(block.train.sum())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), ids, pa.array([block.pack()], pa.binary()), pa.array([pack_strings(words)], pa.binary()), pa.array([n], pa.list_(pa.float64()))], ["block", "ids", "payload", "words", "stats"])

    blocks = checkpointed(texts.mapInArrow(tokenise, f"block long, ids array<{kind}>, payload binary, words binary, stats array<double>"))
    all_tokens, starts = blocks.agg(F.coalesce(F.sum(F.col("stats")[0]), F.lit(0.0)), F.coalesce(F.sum(F.col("stats")[1]), F.lit(0.0))).first()
    n, starts = max(LEAST_PARTS, int(all_tokens) // PART_TOKENS), int(starts)
    by_key = lambda df, f: df.groupBy("key").applyInArrow(f, MESSAGE)

    words = checkpointed(by_key(blocks.select("block", "payload", "words").mapInArrow(lambda it: _asked(it, n), MESSAGE), lambda t: _words(t, n)))
    total, kinds, *of_counts = _sums(words) or [0.0] * (K + 4)
    uni = Unigrams.of(total, kinds, np.array(of_counts))
    release(docs)

    told = words.where(F.col("kind") == WORDS)
    as_text = blocks.select(F.lit(-1).cast("long").alias("key"), "block", F.lit(TEXT).alias("kind"), "payload", F.lit(None).cast("array<double>").alias("stats"))
    pairs = as_text.unionByName(told).groupBy("block").applyInArrow(lambda t: _pairs(t, n), MESSAGE)
    bigrams = checkpointed(by_key(pairs, lambda t: _bigrams(t, n, uni)))
    d = discounts(np.array(_sums(bigrams) or [0.0] * (K + 2)))
    release(docs)

    weights = checkpointed(by_key(bigrams.where(F.col("kind") == CONTEXTS).unionByName(told), lambda t: _weights(t, n, d, starts)))
    first = tuple(_sums(weights) or (1.0, 1.0))
    release(docs)

    names = ["n_tokens", "n_known", "base_score", "score"]

    def score(table: pa.Table) -> pa.Table:
        by_kind: dict[int, dict[int, bytes]] = {TEXT: {}, WORDS: {}, COUNTS: {}, WEIGHTS: {}}
        for key, k, payload in zip(*[table.column(c).to_pylist() for c in ("key", "kind", "payload")], strict=True):
            by_kind[k][key] = payload
        block = Block.unpack(by_kind[TEXT][-1])
        got = score_block(Known.of(block, by_kind[WORDS], n), by_kind[COUNTS], by_kind[WEIGHTS], n, uni, d, starts, first)
        ids = next(x for x in table.column("ids") if x.is_valid).values
        return pa.Table.from_arrays([ids, pa.array(~block.train), *[pa.array(got[c]) for c in names]], ["id", "held_out", *names])

    none = F.lit(None).cast(f"array<{kind}>").alias("ids")
    mail = [x.select("key", "block", "kind", "payload", none) for x in (told, bigrams.where(F.col("kind") == COUNTS), weights.where(F.col("kind") == WEIGHTS))]
    whole = blocks.select(F.lit(-1).cast("long").alias("key"), "block", F.lit(TEXT).alias("kind"), "payload", "ids")
    for m in mail:
        whole = whole.unionByName(m)
    scored = whole.groupBy("block").applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")


def query(docs: DataFrame) -> DataFrame:
    return score_texts(docs, hash_fold("doc_id", FOLDS) != HELD_OUT).withColumnRenamed("id", "doc_id")
