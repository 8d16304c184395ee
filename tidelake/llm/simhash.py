"""Near-dedup: SimHash with keys from the binary Golay code, on 64 bits or, for texts of a wanted similarity, on more bits with links decided on the shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALL, KEY, ROW, checkpointed, mix64, text_batches, text_key, with_columns
from .components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Bits of a fingerprint's three segments; each is the low end of a word of the (23, 12) Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LENGTH, CHECKS = 23, 11
#: Generator of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Members of one key up to which all of them are compared at once; a larger group is cut by parts of the print, and what is still large is walked.
SMALL = 12
#: Parts of a print of one word, of so many bits: four differing bits leave one of five equal.
PARTS = (0, 13, 26, 39, 52)
PART = 13
#: Different prints that a task expands to keys.
PRINTS_PER_TASK = 16_384


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's shingles of words (bytes between spaces, A-Z lower-cased), repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[: len(words) - k + 1], ends[k - 1 :], strict=True)])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(np.frombuffer(hashes[i * 8 : (i + (1 << 16)) * 8], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    r = words.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        r = np.where((r >> np.uint32(bit)) & np.uint32(1), r ^ np.uint32(GENERATOR << (bit - CHECKS)), r)
    return r


@lru_cache(maxsize=1)
def decoding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of the nearest codeword; errors of all codewords reached after flipping one bit or none; how many these are.

    The code is perfect: each word is within 3 of one codeword. A word within 2 of its codeword keeps it whatever bit is flipped; one
    at distance 3 reaches five more codewords, at distance 4. So a word has 1 or 6 keys, and two words that differ in two bits share one.
    """
    nearest = np.zeros(1 << CHECKS, np.uint32)
    errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(LENGTH), k)], np.uint32)
    nearest[syndromes(errors)] = errors
    flips = np.array([0] + [1 << b for b in range(LENGTH)], np.uint32)
    s = np.arange(1 << CHECKS, dtype=np.uint32)
    reached = flips ^ nearest[s[:, None] ^ syndromes(flips)]
    reached.sort(axis=1)
    table, sizes = np.zeros((1 << CHECKS, 6), np.uint32), np.zeros(1 << CHECKS, np.int64)
    for k in range(1 << CHECKS):
        u = np.unique(reached[k])
        table[k, : len(u)], sizes[k] = u, len(u)
    return nearest, table, sizes


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, whether it is a base key) of each fingerprint.

    Four errors leave two of the three segments with two in all. Either each has one at most: then one print's decoded pair is among the
    other's pairs of keys, so pairs of decoded words are base keys and all pairs are looked up. Or one segment is equal, and the other's
    keys have one in common: equal segment and each key, all of them base keys.
    """
    nearest, table, sizes = decoding()
    rows = np.arange(len(prints))
    words, many, owners, own = [], [], [], []
    for shift, width in SEGMENTS:
        w = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        s = syndromes(w)
        take = np.arange(6) < sizes[s][:, None]
        words.append(w.astype(np.uint64))
        own.append(((w ^ nearest[s]) >> np.uint32(CHECKS)).astype(np.uint64))
        many.append(((w[:, None] ^ table[s]) >> np.uint32(CHECKS)).astype(np.uint64))
        owners.append(take)
    keys, row, base = [], [], []

    def add(kind: int, k: np.ndarray, r: np.ndarray, b: np.ndarray | bool) -> None:
        keys.append(k | np.uint64(kind << 50))
        row.append(r)
        base.append(np.broadcast_to(b, k.shape))

    for kind, (a, b) in enumerate(combinations(range(3), 2)):
        pair = (many[a][:, :, None] << np.uint64(12)) | many[b][:, None, :]
        ok = owners[a][:, :, None] & owners[b][:, None, :]
        mine = (own[a] << np.uint64(12)) | own[b]
        add(kind, pair[ok], np.broadcast_to(rows[:, None, None], ok.shape)[ok], (pair == mine[:, None, None])[ok])
        for side, (x, y) in enumerate(((a, b), (b, a))):
            k = (words[x][:, None] << np.uint64(12)) | many[y]
            add(3 + 2 * kind + side, k[owners[y]], np.broadcast_to(rows[:, None], owners[y].shape)[owners[y]], True)
    return np.concatenate(keys), np.concatenate(row), np.concatenate(base)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which prints (of one or several words) differ."""
    n = np.bitwise_count(x ^ y)
    return n if n.ndim == 1 else n.sum(axis=-1, dtype=np.int64)


def linked(keys: np.ndarray, prints: np.ndarray, base: np.ndarray, bits: int = BITS, nodes: np.ndarray | None = None, cut: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the prints of each key (keys sorted): as many as keep what is connected together. ``nodes``: the prints' names; ``cut``: keys of large groups have parts of the prints in them already."""
    nodes = prints if nodes is None else nodes
    first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    size = np.diff(np.concatenate([first, [len(keys)]]))
    left, right = [nodes[:0]], [nodes[:0]]
    small = (size > 1) & (size <= SMALL)
    for m in np.unique(size[small]):
        at = first[small & (size == m)][:, None] + np.arange(m)
        for i, j in combinations(range(int(m)), 2):
            x, y = at[:, i], at[:, j]
            hit = (base[x] | base[y]) & (differing(prints[x], prints[y]) <= bits)
            left.append(nodes[x[hit]])
            right.append(nodes[y[hit]])
    large = size > SMALL
    if not cut and prints.ndim == 1 and bits < len(PARTS) and large.any():
        # Within a key, prints that are linked are equal in one part at least: a key of its number, the part's and its bits.
        at = np.flatnonzero(np.repeat(large, size))
        own = np.repeat(np.arange(len(first), dtype=np.uint64), size)[at] * np.uint64(len(PARTS))
        key = np.concatenate([(own + np.uint64(k)) << np.uint64(PART) | (prints[at] >> np.uint64(shift)) & np.uint64((1 << PART) - 1) for k, shift in enumerate(PARTS)])
        order, rows = np.argsort(key, kind="stable"), np.tile(at, len(PARTS))
        rows = rows[order]
        x, y = linked(key[order], prints[rows], base[rows], bits, nodes[rows], True)
        left.append(x)
        right.append(y)
    else:
        for at, m in zip(first[large].tolist(), size[large].tolist(), strict=True):
            x, y = walked(prints[at : at + m], base[at : at + m], bits)
            left.append(nodes[at + x])
            right.append(nodes[at + y])
    x, y = np.concatenate(left), np.concatenate(right)
    return np.minimum(x, y), np.maximum(x, y)


def walked(prints: np.ndarray, base: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one key's group, by walks over the prints not reached yet: a close group is reached in a few steps. Places are returned."""
    order = np.argsort(~base, kind="stable")
    prints, n_base = prints[order], int(base.sum())
    left, right = [order[:0]], [order[:0]]
    rest = np.arange(len(prints))
    while len(rest) and rest[0] < n_base:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            u = stack.pop()
            near = differing(prints[rest], prints[u]) <= bits
            if u >= n_base:
                near &= rest < n_base
            got = rest[near]
            rest = rest[~near]
            left.append(np.full(len(got), order[u]))
            right.append(order[got])
            stack += got.tolist()
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that isn't its component's smallest: pointers to smaller neighbours, jumped until they rest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        lo = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], lo)
        np.minimum.at(new, up[y], lo)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, up):
            break
        up = new
    moved = up != np.arange(len(nodes))
    return nodes[moved], nodes[up[moved]]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(ROW, id, print) of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_batches(batch, 2):
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(prints)], [ROW, "id", "print"])

    return rows.mapInArrow(make, f"{ROW} long, id {kind}, print long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between different fingerprints at ``bits`` or fewer differing bits, enough of them to connect what is connected.

    Each distinct fingerprint gets about 110 keys. Keys are dealt out by hash, sorted within partitions and read in batches; only
    a key that batches cut is carried over. A key's group holds different fingerprints that are close in two segments; it
    is compared at once or walked, and links are verified on all 64 bits. A task returns a forest of what it found.
    """
    if bits > 4:
        raise ValueError("two segments share four errors at most")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 2000):
                p = every[i : i + 2000]
                keys, row, base = golay_keys(p)
                yield pa.RecordBatch.from_arrays([pa.array((keys << np.uint64(1) | base).view(np.int64)), pa.array(p[row].view(np.int64))], ["key", "print"])

    different = checkpointed(prints.select("print").distinct())
    tasks = max(1, -(-different.count() // PRINTS_PER_TASK))
    keys = different.repartition(tasks, "print").mapInArrow(keys_of, "key long, print long")
    return keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_matcher(bits), "a long, b long")


def _matcher(bits: int):
    """Rows (key, whose lowest bit is the base mark; words of the print) in order of the key -> a forest of the links (a, b) in all keys of a task."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def settle(rows: np.ndarray) -> None:
            nonlocal a, b
            prints = rows[1] if len(rows) == 2 else np.ascontiguousarray(rows[1:].T)
            x, y = linked(rows[0] >> np.uint64(1), prints, (rows[0] & np.uint64(1)).astype(bool), bits, node(rows[1:]))
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0] >> np.uint64(1), rows[0, -1] >> np.uint64(1)))
            if cut or (held and held[-1][0, -1] >> np.uint64(1) != rows[0, 0] >> np.uint64(1)):
                settle(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            settle(np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return match


def node(words: np.ndarray) -> np.ndarray:
    """One number for prints of several words (words x prints); a print of one word is its own."""
    out = words[0]
    for w in words[1:]:
        out = mix64(out) ^ w
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(ROW, id, fingerprint, component_id): a row for each row of ``docs``; component_id is the smallest id in its component.

    Equal fingerprints are one node, so copies never meet in pairs. Null or empty text: fingerprint 0, linked like any other. A long text's
    shingles are counted whole. Null
    ids: never a component's id, unless it has no other. Repeated rows: one component. Ties of ids: one component's id. Empty table: no rows. Other columns
    are left out, whatever their names.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    roots = components(links(prints, bits))
    nodes = prints.groupBy(F.col("print").alias("p")).agg(F.min("id").alias("least"))
    placed = nodes.join(roots, F.col("p") == F.col("node"), "left").select("p", "least", F.coalesce("root", "p").alias("root"))
    # Minima are written first: both sides of the join are then exchanged, and a component with many prints can be split.
    smallest = checkpointed(placed.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")))
    known = checkpointed(placed.select("p", "root").join(smallest, F.col("root") == F.col("r")).select("p", "component_id"))
    return prints.join(known, F.col("print") == F.col("p")).select(ROW, "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# Texts of a given similarity: candidates share a key of a SimHash of several words, and links are decided on the shingles themselves.

#: A segment catches two texts as often as a chance of similarity ** KEY_VALUES (measured, from 0.8 on); chance that texts at the wanted similarity share a
#: key, which sets the number of segments; bits of a sketch, the first of a print.
KEY_VALUES, RECALL, SKETCH = 5, 0.9999, 128
#: Bits of a segment that are most nearly even, all choices of which are flipped before it is decoded; codewords kept of those found; keys of two segments.
EVEN, CODEWORDS, PAIRS = 6, 8, 8
#: Shingles up to which a text has twice as many segments: its counts are small numbers, often even.
SHORT = 64
#: Cost of what isn't there; margins beyond WIDE count as WIDE, so costs are exact.
NEVER, WIDE = 1 << 36, (1 << 16) - 1
#: Deviations past the expected difference (more of it in texts of eight words, whose counts are often even) up to which two sketches' texts are compared.
DEVIATIONS = 5.5
#: Members of a large group that are compared in one unit; more are cut into parts, a unit for each two of them.
UNIT = 1024
#: Members of a key up to which those that are close to no other one are left out.
CROWD = 4096


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles of words; a text with fewer words is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends[:-1]][: len(words) - k + 1], ends[k - 1 :], strict=True)]), np.uint64))


def keys_at(similarity: float) -> int:
    """Segments, by pairs, of which texts at this similarity share a key with a chance of RECALL at least."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity: over 0, up to 1")
    n = 1 if similarity == 1 else int(np.ceil(np.log(1 - RECALL) / np.log1p(-(similarity**KEY_VALUES))))
    return n + n % 2


def bits_at(similarity: float) -> int:
    """Bits in which sketches at this similarity differ, DEVIATIONS past the mean: each differs with a chance of the angle's share of a half-turn."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(SKETCH * p + DEVIATIONS * np.sqrt(SKETCH * p * (1 - p))))


def margins(hashes: np.ndarray, words: int) -> np.ndarray:
    """For each bit of a SimHash of so many words: how many more of the hashes set it than don't."""
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64))
    counts = np.zeros(words * 64, np.int64)
    for i in range(0, len(hashes), 255):
        # A bit is a byte of a 64-bit lane: 255 rows add up without a carry.
        lanes = np.unpackbits(mix64(hashes[i : i + 255, None] ^ salts).view(np.uint8), axis=1).view(np.uint64)
        counts += lanes.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return 2 * counts - len(hashes)


@lru_cache(maxsize=1)
def flips() -> np.ndarray:
    """All choices of EVEN bits, a row each."""
    return (np.arange(1 << EVEN)[:, None] >> np.arange(EVEN)) & 1


def least(costs: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` smallest different numbers of each row in order; what is missing costs NEVER."""
    costs = np.sort(costs, axis=1)
    costs[:, 1:][costs[:, 1:] == costs[:, :-1]] = NEVER << 12
    return np.sort(costs, axis=1)[:, :n]


def codewords(segments: np.ndarray) -> np.ndarray:
    """Of segments' margins (segments x LENGTH): cost << 12 | data bits of the CODEWORDS codewords that cost least, those found by decoding after flips.

    A codeword costs the margins of the bits in which it differs from the segment, so that bits which nearly went the other way cost little.
    """
    nearest = decoding()[0]
    out = np.zeros((len(segments), CODEWORDS), np.int64)
    for i in range(0, len(segments), 512):
        m = segments[i : i + 512]
        weight = np.minimum(np.abs(m), WIDE)
        word = ((m > 0) << np.arange(LENGTH)).sum(axis=1).astype(np.uint32)
        # The place breaks ties, so that the choice is the same everywhere.
        even = np.argsort(weight * LENGTH + np.arange(LENGTH), axis=1)[:, :EVEN]
        tried = word[:, None] ^ ((1 << even) @ flips().T).astype(np.uint32)
        code = tried ^ nearest[syndromes(tried)]
        errors = np.unpackbits((code ^ word[:, None]).astype("<u4").view(np.uint8).reshape(*code.shape, 4), axis=2, bitorder="little")[:, :, :LENGTH]
        cost = np.matmul(errors.astype(np.float32), weight.astype(np.float32)[:, :, None])[:, :, 0].astype(np.int64)
        out[i : i + 512] = least(cost << 12 | (code >> np.uint32(CHECKS)).astype(np.int64), CODEWORDS)
    return out


def paired(found: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (pairs x PAIRS) of segments' codewords, two and two, that cost least; which of them are there. ``pair``: each pair's number in its text."""
    i, j = np.array([(i, j) for i in range(CODEWORDS) for j in range(CODEWORDS) if (i + 1) * (j + 1) <= PAIRS]).T
    x, y = found[0::2][:, i], found[1::2][:, j]
    best = np.sort(((x >> 12) + (y >> 12)) << 24 | (x & 4095) << 12 | y & 4095, axis=1)[:, :PAIRS]
    return (best & ((1 << 24) - 1) | pair[:, None] << 24).astype(np.uint32), best >> 24 < NEVER


def code_keys(sets: list[np.ndarray], similarity: float) -> tuple[list[bytes], np.ndarray]:
    """Of sets of shingles: keys (32 bits each: the number of a pair of segments, both codewords); sketches, the first SKETCH bits of a SimHash. An empty set has neither."""
    n = keys_at(similarity)
    many = np.array([0 if not len(h) else 2 * n if len(h) * similarity <= SHORT else n for h in sets])
    sketches, parts = np.zeros((len(sets), SKETCH // 64), np.uint64), [np.zeros((0, LENGTH), np.int64)]
    for i in np.flatnonzero(many).tolist():
        m = margins(sets[i], -(-(SKETCH + int(many[i]) * LENGTH) // 64))
        sketches[i] = np.packbits(m[:SKETCH] > 0).view(np.uint64)
        parts.append(m[SKETCH : SKETCH + many[i] * LENGTH].reshape(-1, LENGTH))
    ends = np.cumsum(many // 2)
    keys, there = paired(codewords(np.concatenate(parts)), np.arange(ends[-1]) - np.repeat(ends - many // 2, many // 2))
    return [keys[a:b][there[a:b]].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], sketches


def key_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (columns x rows, the first being the key) in order of the key, cut only between keys."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        cut = int(np.argmax(rows[0] == rows[0, -1]))
        if cut or (held and held[-1][0, -1] != rows[0, 0]):
            yield np.concatenate([*held, rows[:, :cut]], axis=1)
            held = []
        held.append(rows[:, cut:])
    if held:
        yield np.concatenate(held, axis=1)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of equal keys."""
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return first, np.diff(first, append=len(keys))


def _proposer(limit: int):
    """Rows (key, node, sketch's two words) of small groups in order of the key -> pairs of nodes (a, b) whose sketches are within ``limit``."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_groups(batches):
            nodes, sketches = rows[1], np.ascontiguousarray(rows[2:4].T)
            first, size = bounds(rows[0])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m in np.unique(size):
                at = first[size == m][:, None] + np.arange(m)
                for i, j in combinations(range(int(m)), 2):
                    near = differing(sketches[at[:, i]], sketches[at[:, j]]) <= limit
                    left.append(at[near, i])
                    right.append(at[near, j])
            x, y = nodes[np.concatenate(left)], nodes[np.concatenate(right)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))], ["a", "b"])

    return propose


def spanning(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, that connect all that is connected by pairs of sets whose Jaccard similarity is ``similarity`` or more: each by itself is such a pair.

    A set outside of the largest component so far is compared with all that aren't in its own, until none outside is left that hasn't been. So a close
    group takes a few steps, and whatever is between two components is found from the smaller one.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
    root, done, left, right = np.arange(n), np.zeros(n, bool), [], []
    mark = np.zeros(len(kinds), bool)
    while True:
        counts = np.bincount(root, minlength=n)
        todo = np.flatnonzero(~done & (root != counts.argmax()))
        if not len(todo):
            return np.array(left, np.int64), np.array(right, np.int64)
        x = int(todo[0])
        own = token[starts[x] : starts[x] + size[x]]
        mark[own] = True
        common = np.add.reduceat(mark[token], starts, dtype=np.int64)
        mark[own] = False
        done[x] = True
        for y in np.flatnonzero((common >= similarity * (size + size[x] - common)) & (root != root[x])).tolist():
            if root[y] != root[x]:
                left.append(x)
                right.append(y)
                root[root == root[y]] = root[x]


def _spanner(similarity: float):
    """Rows (unit, node, set of shingles) in order of the unit -> for each unit, links (a, b) that connect what is connected in it."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sets = None, [], []

        def settle() -> pa.RecordBatch:
            x, y = spanning(sets, similarity)
            names = np.array(nodes, np.int64)
            a, b = names[x].view(np.uint64), names[y].view(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], ["a", "b"])

        for batch in batches:
            for u, node_, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if u != unit and nodes:
                    yield settle()
                    nodes, sets = [], []
                unit = u
                nodes.append(node_)
                sets.append(np.frombuffer(own.as_py(), np.uint64))
        if nodes:
            yield settle()

    return span


def close_ones(sketches: np.ndarray, first: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """Of members of keys (runs from ``first`` on): whether another one under the key has a sketch within ``limit``. In a group over CROWD, all count as close."""
    close = np.zeros(len(sketches), bool)
    for m in np.unique(size[(size > 1) & (size <= SMALL)]):
        at = first[size == m][:, None] + np.arange(m)
        for i, j in combinations(range(int(m)), 2):
            near = differing(sketches[at[:, i]], sketches[at[:, j]]) <= limit
            close[at[near, i]] = close[at[near, j]] = True
    for a, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        if m > CROWD:
            close[a : a + m] = True
            continue
        own = sketches[a : a + m]
        for i in range(0, m, 256):
            close[a + i : a + min(i + 256, m)] = (differing(own[i : i + 256, None], own[None]) <= limit).sum(axis=1) > 1
    return close


def _met(limit: int):
    """Rows (key, node, sketch's two words) in order of the key -> those close to others of their key, and how many of the key are."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_groups(batches):
            if not rows.shape[1]:
                continue
            first, size = bounds(rows[0])
            close = close_ones(np.ascontiguousarray(rows[2:4].T), first, size, limit)
            many = np.repeat(np.add.reduceat(close, first, dtype=np.int64), size)[close]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows[:, close]], pa.array(many)], ["key", "node", "p0", "p1", "many"])

    return meet


def _alike(similarity: float):
    """Pairs (a, b, both sets of shingles) -> those (a, b) whose Jaccard similarity is ``similarity`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1:
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    hit[i] = n / (len(x) + len(y) - n) >= similarity
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in batch.columns[:2]], ["a", "b"])

    return compare


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, id, component), a row for each document; see ``similar_sets``."""
    prints, roots = similar_sets(docs, id_col, text_col, shingle, similarity)
    return prints.select(KEY, "own").join(roots, F.col("own") == F.col("node"), "left").select(KEY, F.col(KEY)["id"].alias("id"), F.coalesce("root", "own").alias("component"))


def similar_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, own, ..), a row for each document with its set's name, and (node, root) for the names of sets in components of several: components of documents linked where the Jaccard similarity of their sets of shingles is ``similarity`` or more.

    Equal sets are one node, so copies never meet in pairs. A set's SimHash is cut into segments (24 at 0.8) that are words of the Golay code. Two by two they
    make keys of the codewords nearest to them, measured by the bits' margins, so that 99.99 % of texts at the threshold share one, and more above it; short
    texts have twice as many. Texts whose sketches are far from those of all others under a key (five and a half deviations past what is expected at the threshold)
    are left out, in a small group pairs are; every other link is decided on both sets. In a large group, sets are compared in units of bounded size, which
    leaves no pair out but those that are connected already; no pairs are emitted. The key is ``text_key``: id and the text's MD5.

    Null or empty text: as any texts without words, one component. Long texts: whole. Null ids: like any. Repeated rows: one component. Ties: none. Empty
    table: no rows. Other columns are left out, whatever their names.
    """
    limit = bits_at(similarity)
    rows = docs.select(text_key(id_col, F.col(text_col)).alias(KEY), F.col(text_col).alias("text"))
    kind = rows.schema[KEY].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for a, b, texts in text_batches(batch, 1):
                sets = [shingles(t, shingle) for t in texts]
                own = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0 for h in sets], np.uint64)
                packed, sketches = code_keys(sets, similarity)
                cols = [own, *[np.ascontiguousarray(sketches[:, i]) for i in range(2)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c.view(np.int64)) for c in cols], pa.array(packed, pa.binary())], [KEY, "own", "p0", "p1", "keys"])

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            packed = batch.column(3).to_pylist()
            keys = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
            cols = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), [len(k) // 4 for k in packed])) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *cols], ["key", "node", "p0", "p1"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_batches(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shingles(t, shingle).tobytes() for t in texts], pa.binary())], ["node", "set"])

    prints = checkpointed(rows.mapInArrow(make, f"{KEY} {kind}, own long, p0 long, p1 long, keys binary"))
    dealt = prints.where(F.length("keys") > 0).select("own", "p0", "p1", "keys").distinct().mapInArrow(keys_of, "key long, node long, p0 long, p1 long")
    met = checkpointed(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_met(limit), "key long, node long, p0 long, p1 long, many long"))
    # A text of each node that met others; the texts of its other copies stay where they are.
    # Copies are put together before anything is joined, so that a text with many is one row.
    chosen = prints.groupBy("own").agg(F.min(F.col(KEY)["text"]).alias("t")).join(met.select("node").distinct(), F.col("own") == F.col("node")).select("node", "t")
    texts = rows.select(F.col(KEY)["text"].alias("m"), "text").join(chosen, F.col("m") == F.col("t"))
    sets = checkpointed(texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(sets_of, "node long, set binary"))
    # Small groups: pairs, each once however many keys it shares, joined with both sets.
    small = met.where(F.col("many") <= SMALL).select("key", "node", "p0", "p1")
    pairs = small.repartition("key").sortWithinPartitions("key").mapInArrow(_proposer(limit), "a long, b long").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    found = both.select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long")
    # Large ones: each member's set goes to its unit, and only links that connect something come back.
    parts = F.ceil(F.col("many") / F.lit(UNIT)).cast("long")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = met.where(F.col("many") > SMALL).select("key", "node", parts.alias("parts")).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = dealt.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "node")
    held = units.join(sets.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("unit", "node", "set")
    spanned = held.repartition("unit").sortWithinPartitions("unit").mapInArrow(_spanner(similarity), "a long, b long")
    roots = checkpointed(components(checkpointed(found.unionByName(spanned))))
    return prints, roots


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that come first by id in their component, one for each; all columns.

    Null ids come last; of equal ids the text with the smaller MD5 comes first, and of rows equal in id and text any one stays. For other cases see ``similar_sets``.
    """
    prints, roots = similar_sets(docs, id_col, text_col, shingle, similarity)
    # The first of each set's copies, then the first of each component.
    firsts = prints.groupBy("own").agg(F.min(F.struct(F.col(KEY)["id"].isNull().alias("none"), F.col(KEY).alias("k"))).alias("first"))
    first = firsts.join(roots, F.col("own") == F.col("node"), "left").groupBy(F.coalesce("root", "own").alias("component")).agg(F.min("first")["k"].alias("k"))
    rows = docs.select(F.struct(*docs.columns).alias(ALL), text_key(id_col, F.col(text_col)).alias(KEY))
    one = rows.join(checkpointed(first), F.col(KEY) == F.col("k")).groupBy(KEY).agg(F.first(ALL).alias(ALL))
    return one.select(*with_columns(docs, ALL, {}))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
