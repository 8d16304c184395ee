"""Removal of repeated byte strings with run-length compressed suffix indexes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, bundle, checkpointed, numbered, pack_ints, pack_strings, pack_text, release, runs, strings_array, text_batches, unbundle, unpack_ints, unpack_strings, unpack_text

#: Length of a repeated string, of the strings by whose least hash its windows are dealt out, and so how many of these a window has.
SPAN, SEED = 50, 28
SEEDS = SPAN - SEED + 1
#: Bytes of text in a block; for each part (a message goes from each block to each part); for each index. With indexes of this size, places in
#: their strings take 21 bits, so that two ranks and a place are sorted as one number.
BLOCK_BYTES, PART_BYTES, INDEX_BYTES, LEAST_PARTS = 4 << 20, 64 << 20, 2 << 20, 48
#: Windows looked at together, so that their hashes stay in a core's cache; bits of a place among them.
CHUNK, PLACE_BITS = 1 << 16, 17
#: A seed in more runs than this, of this many kinds at least, is split into single windows.
HOT, KINDS = 1 << 14, 64
SEPARATOR = 0xFF  # never a byte of UTF-8
MESSAGE = "key long, block long, kind int, payload binary"
TEXT, SEEN, STRINGS, PLACES, MARKS = range(5)
#: Odd multipliers of the seeds' hash, from the digits of pi's fraction.
ODD = tuple(np.uint64(x | 1) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377))


def rows(items: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in items], t) for i, t in enumerate(types)], ["key", "block", "kind", "payload"])


class Layout(NamedTuple):
    """How seeds are dealt out: bits of a seed, parts, indexes in a part, runs from which on a seed is hot."""

    bits: int
    parts: int
    indexes: int
    hot: int

    @classmethod
    def of(cls, size: int, hot: int) -> Layout:
        """For so many bytes of text: seeds are long enough that few of different strings are equal by chance."""
        parts = max(LEAST_PARTS, size // PART_BYTES)
        return cls(min(64 - PLACE_BITS, max(40, size.bit_length() + 8)), parts, -(-size // (parts * INDEX_BYTES)) or 1, hot)

    def index_of(self, seeds: np.ndarray) -> np.ndarray:
        """The index of each seed, by range; those of a part follow each other. Only the highest bits count, so products stay below 64 bits."""
        top = min(self.bits, 36)
        return ((seeds >> np.uint64(self.bits - top)) * np.uint64(self.parts * self.indexes) >> np.uint64(top)).astype(np.int64)


class Pieces(NamedTuple):
    """Runs of windows with the same seed: the first window's place, how many there are, the seed's hash."""

    start: np.ndarray
    count: np.ndarray
    seed: np.ndarray


def eights(data: np.ndarray, first: int, n: int) -> np.ndarray:
    """The eight bytes from each of ``n`` places on, as numbers; ``data`` goes on for seven bytes."""
    return np.array(np.ndarray((n,), "<u8", data, first, (1,)))


def scrambled(x: np.ndarray) -> np.ndarray:
    """In place: each bit depends on all lower ones, then on all."""
    x ^= x >> np.uint64(31)
    x *= ODD[4]
    x ^= x >> np.uint64(29)
    return x


def pieces(data: np.ndarray, sizes: np.ndarray, bits: int) -> Pieces:
    """Every window of SPAN bytes within a text belongs to one run; its seed is the string of SEED bytes in it with the least hash, the first of equal ones.

    Hashes only choose and deal out: whether strings are equal is decided on their bytes.
    """
    total = len(data) - SPAN + 1
    if total <= 0:
        return Pieces(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    ends = np.cumsum(sizes)
    cut = np.bincount(np.maximum(ends - SPAN + 1, ends - sizes), minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
    whole = np.cumsum(cut)[:total] == 0  # whether a window ends within its text
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    place = np.arange(CHUNK + SEEDS, dtype=np.uint64)
    starts, counts, seeds = [], [], []
    for a in range(0, total, CHUNK):
        b = min(total, a + CHUNK)
        n = b - a + SEEDS - 1
        w = eights(padded, a, n + SEED - 8)
        h = w[:n] * ODD[0]
        for k, at in enumerate((8, 16, SEED - 8), 1):
            h += w[at : at + n] * ODD[k]
        h = scrambled(h)
        h >>= np.uint64(PLACE_BITS)
        h <<= np.uint64(PLACE_BITS)
        h |= place[:n]
        width = 1
        while 2 * width <= SEEDS:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if SEEDS > width:
            h = np.minimum(h[: width - SEEDS], h[SEEDS - width :])
        own = whole[a:b]
        new = np.empty(b - a + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(h[1:], h[:-1], out=new[1:-1])
        gap = ~own
        first = np.flatnonzero(own & (new[:-1] | np.concatenate([[True], gap[:-1]])))
        last = np.flatnonzero(own & (new[1:] | np.concatenate([gap[1:], [True]])))
        starts.append(first + a)
        counts.append(last - first + 1)
        # Least hashes are small numbers; the product spreads them over all seeds.
        seeds.append((h[first] >> np.uint64(PLACE_BITS)) * ODD[1] << np.uint64(PLACE_BITS) >> np.uint64(64 - bits))
    return Pieces(np.concatenate(starts), np.concatenate(counts), np.concatenate(seeds))


def pack_ids(ids: np.ndarray) -> bytes:
    return pack_text(np.ascontiguousarray(ids, np.int64).tobytes())


def unpack_ids(b: bytes) -> np.ndarray:
    return np.frombuffer(unpack_text(b), np.int64)


def _block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, sizes, ids = unbundle(payload)
    return np.frombuffer(unpack_text(text), np.uint8), unpack_ints(sizes).astype(np.int64), unpack_ids(ids)


def _document(start: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(np.cumsum(sizes), start, side="right")] if len(start) else ids[:0]


def strings_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of ``size`` bytes from ``start`` on."""
    return strings_array(data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size)


def by_range(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each part that occurs among ``parts``, which are in order, and where."""
    known, first = np.unique(parts, return_index=True)
    for p, a, b in zip(known.tolist(), first.tolist(), [*first[1:].tolist(), len(parts)], strict=True):
        yield p, slice(a, b)


def _seeds(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """For each block and part: its seeds, whether they are in several documents of the block, how many runs have them (a power of 2), and a byte that tells what one of these looks like."""
    for batch in batches:
        for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            data, sizes, ids = _block(payload)
            p = pieces(data, sizes, layout.bits)
            if not len(p.start):
                continue
            order, rank = _ranked(p.seed, layout.bits)
            doc, first = _document(p.start, sizes, ids)[order], np.flatnonzero(np.diff(rank[order], prepend=np.uint64(1 << 63)))
            change = np.concatenate([[False], doc[1:] != doc[:-1]])
            change[first] = False
            # What a run looks like: its first and its last eight bytes.
            one = order[first]
            w = np.concatenate([data, np.zeros(8, np.uint8)])
            looks = lambda at: np.frombuffer(w[at[:, None] + np.arange(8)].tobytes(), "<u8")
            look = scrambled(looks(p.start[one]) * ODD[2] + looks(p.start[one] + p.count[one] + SPAN - 9) * ODD[3]) >> np.uint64(56)
            size = np.diff(first, append=len(order))
            seed, several, log = p.seed[one], np.add.reduceat(change, first) > 0, np.floor(np.log2(size)).astype(np.int64)
            yield rows([(k, number, SEEN, bundle(pack_ints(seed[at], True), pack_ints(several[at] + 2 * log[at]), look[at].astype(np.uint8).tobytes())) for k, at in by_range(layout.index_of(seed) // layout.indexes)])


def _shared(table: pa.Table, hot: int) -> pa.Table:
    """One part of the seeds: for each block, which of its seeds are in several documents or blocks, and which of these are hot."""
    part, blocks = table.column("key")[0].as_py(), table.column("block").to_pylist()
    asked = [(unpack_ints(s), unpack_ints(c), np.frombuffer(x, np.uint8)) for s, c, x in (unbundle(p) for p in table.column("payload").to_pylist())]
    known, at = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    count = np.concatenate([x[1] for x in asked])
    many = np.bincount(at, weights=1.0 + (count & np.uint64(1)).astype(np.float64), minlength=len(known)) > 1
    in_runs = np.bincount(at, weights=np.exp2((count >> np.uint64(1)).astype(np.float64)), minlength=len(known))
    found = np.zeros(len(known), bool)
    busy = np.flatnonzero(in_runs > hot)
    if len(busy):
        # Kinds: different looks of runs in different blocks, and all runs of blocks that have many.
        of = np.full(len(known), -1)
        of[busy] = np.arange(len(busy))
        own = of[at] >= 0
        kinds = np.bincount(np.unique(of[at][own] << 8 | np.concatenate([x[2] for x in asked])[own]) >> 8, minlength=len(busy))
        most = np.zeros(len(busy))
        np.maximum.at(most, of[at][own], np.exp2((count[own] >> np.uint64(1)).astype(np.float64)))
        found[busy] = (kinds >= KINDS) | (most > hot / KINDS)
    out, i = [], 0
    for b, (h, _, _) in zip(blocks, asked, strict=True):
        own = at[i : i + len(h)]
        i += len(h)
        own = own[many[own]]
        out.append((part, b, SEEN, bundle(pack_ints(known[own], True), pack_ints(found[own]))))
    return pa.Table.from_batches([rows(out)])


def shared_runs(data: np.ndarray, sizes: np.ndarray, seeds: list[bytes], layout: Layout) -> Pieces:
    """The runs whose seeds are shared; those of hot seeds as single windows, with their own hashes as seeds."""
    p = pieces(data, sizes, layout.bits)
    told = [list(map(unpack_ints, unbundle(s))) for s in seeds]
    known, hot = (np.concatenate([*[t[k] for t in told], np.zeros(0, np.uint64)]) for k in (0, 1))
    order = np.argsort(known, kind="stable")
    known, hot = known[order], hot[order] > 0
    if not len(known) or not len(p.start):
        return Pieces(*[x[:0] for x in p])
    at = np.minimum(np.searchsorted(known, p.seed), len(known) - 1)
    own = np.flatnonzero(known[at] == p.seed)
    start, count, seed, split = p.start[own], p.count[own], p.seed[own], hot[at[own]]
    if split.any():
        n = count[split]
        windows = np.repeat(start[split] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        h = np.zeros(len(windows), np.uint64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(0, SPAN, 8):
            k = min(k, SPAN - 8)
            h = scrambled(h + np.frombuffer(padded[windows[:, None] + np.arange(k, k + 8)].tobytes(), "<u8") * ODD[k // 8 % 4])
        start, count = np.concatenate([start[~split], windows]), np.concatenate([count[~split], np.ones(len(windows), np.int64)])
        seed = np.concatenate([seed[~split], h >> np.uint64(64 - layout.bits)])
    return Pieces(start, count, seed)


def _strings(table: pa.Table, layout: Layout) -> pa.Table:
    """For each part: the different strings of a block's runs with shared seeds, and the smallest document that has each. For the block itself: where they are.

    Other documents of the block with a string need no answer: the smallest one has all its windows.
    """
    block, seeds = None, []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if kind == TEXT:
            block = _block(payload)
        else:
            seeds.append(payload)
    (data, sizes, ids), number, out = block, table.column("block")[0].as_py(), []
    p = shared_runs(data, sizes, seeds, layout)
    if len(p.start):
        doc, size = _document(p.start, sizes, ids), p.count + SPAN - 1
        string, different = numbered(strings_of(data, p.start, size))
        low, index = np.full(len(different), np.iinfo(np.int64).max), np.zeros(len(different), np.int64)
        np.minimum.at(low, string, doc)
        index[string] = layout.index_of(p.seed)
        order = np.argsort(index, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        different, low_, index = different.take(pa.array(order)), low[order], index[order]
        for k, at in by_range(index // layout.indexes):
            out.append((k, number, STRINGS, bundle(pack_ints(index[at] - k * layout.indexes), pack_strings(different.slice(at.start, at.stop - at.start)), pack_ids(low_[at]))))
        by_place = np.argsort(p.start, kind="stable")
        out.append((-1 - number, number, PLACES, bundle(pack_ints(p.start[by_place], True), pack_ints(p.count[by_place]), pack_ints(place[string[by_place]]), pack_ints((doc == low[string])[by_place]))))
    return pa.Table.from_batches([rows(out)])


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of strings, with suffix positions sampled at both ends of each run.

    Strings are compared up to their separator, equal rests by number, so that mapping a row to the one of the longer
    suffix (LF) holds within strings. ``least`` has for each row whose suffix has SPAN bytes or more the smallest document among
    the rows with the same SPAN bytes.
    """

    def __init__(self, strings: list[bytes], docs: np.ndarray):
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff" * (SPAN + 9), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = int((self.sizes + 1).sum())
        owner = np.repeat(np.arange(len(strings)), self.sizes + 1)
        left = (self.starts + self.sizes)[owner] - np.arange(n)  # bytes before the separator
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(left > k, self.text[k : k + n] + np.uint64(1), np.uint64(0))
        self.eight = np.concatenate([key, np.zeros(8, np.uint64)])
        # Ranks by the first 5 bytes, then by twice as many each time; what is past the separator counts as nothing.
        rows_, rank = _ranked(key >> np.uint64(24), 40)
        depth, longest, bits = 5, int(self.sizes.max(initial=0)), int(n).bit_length()
        half, half_depth = rank, depth
        while depth < longest:
            tail = np.zeros(n, np.uint64)
            tail[: max(0, n - depth)] = rank[depth:] + np.uint64(1)
            rows_, rank = _ranked((rank << np.uint64(bits)) | np.where(left > depth, tail, np.uint64(0)), 2 * bits)
            depth *= 2
            if depth <= SPAN:
                half, half_depth = rank, depth
        before = np.where(rows_ == self.starts[owner[rows_]], np.uint8(SEPARATOR), self.text[rows_ - 1])
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.first, self.head = first, before[first]
        self.last = np.concatenate([first[1:], [n]]) - 1
        self.at_first, self.at_last = rows_[self.first], rows_[self.last]
        self.run = np.repeat(np.arange(len(first), dtype=np.int32), self.last - self.first + 1)
        # Where LF takes the first row of each run: the rows of smaller bytes, then this byte's runs before it. Separators sort as the empty rest: first.
        size = self.last - self.first + 1
        order = np.argsort(np.where(self.head == SEPARATOR, 0, self.head.astype(np.int64) + 1), kind="stable")
        self.to = np.empty(len(first), np.int64)
        self.to[order] = np.cumsum(size[order]) - size[order]
        self.of_byte = self.head.astype(np.int64) << 40 | np.arange(len(first))
        self.of_byte.sort()
        # Rows with the same SPAN bytes are neighbours; ranks of fewer bytes at a few places tell.
        long = left[rows_] >= SPAN
        self.least = np.full(n, np.iinfo(np.int64).max)
        if long.any():
            where = rows_[long]
            differ = np.zeros(len(where) - 1, bool)
            for o in (*range(0, SPAN - half_depth, half_depth), SPAN - half_depth):
                r = half[where + o]
                differ |= r[1:] != r[:-1]
            group = np.flatnonzero(np.concatenate([[True], differ]))
            low = np.minimum.reduceat(docs[owner[where]], group)
            self.least[long] = np.repeat(low, np.diff(np.concatenate([group, [len(where)]])))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, up to ``most`` and no separator."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):  # by eight bytes, none of them a separator
            x = self.eight[a[live] + out[live]]
            live = live[(x == self.eight[b[live] + out[live]]) & (x & np.uint64(255) != 0) & (out[live] < most[live])]
            out[live] += 8
        live = np.flatnonzero(out < most)
        while len(live):
            x, y = self.text[a[live] + out[live]], self.text[b[live] + out[live]]
            live = live[(x == y) & (x != SEPARATOR) & (out[live] < most[live])]
            out[live] += 1
        return np.minimum(out, most)

    def matches(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of all strings, from their ends, side by side: (place, strings, lengths of the longest matches there, their rows).

        The row of the longest match so far is kept with its place in the text. If the row's run has the next byte, LF goes on; else the
        nearest runs of that byte above and below are tried, whose sampled places give how much of the match they keep.
        """
        n = len(self.sizes)
        row, place, length = np.zeros(n, np.int64), np.full(n, self.at_first[0]), np.zeros(n, np.int64)
        for k in range(1, int(self.sizes.max(initial=0)) + 1):
            live = np.flatnonzero(self.sizes >= k)
            byte = self.text[self.starts[live] + self.sizes[live] - k]
            q, at, m = row[live], place[live], length[live]
            run = self.run[q].astype(np.int64)
            odd = np.flatnonzero(self.head[run] != byte)
            if len(odd):
                c = byte[odd].astype(np.int64)
                i = np.searchsorted(self.of_byte, c << 40 | run[odd])
                down, up = np.minimum(i, len(self.of_byte) - 1), np.maximum(i - 1, 0)
                below, above = self.of_byte[down] & ((1 << 40) - 1), self.of_byte[up] & ((1 << 40) - 1)
                has_below, has_above = (self.of_byte[down] >> 40 == c) & (i < len(self.of_byte)), (self.of_byte[up] >> 40 == c) & (i > 0)
                keep_below = np.where(has_below, self.common(at[odd], self.at_first[below], np.where(has_below, m[odd], 0)), -1)
                keep_above = np.where(has_above, self.common(at[odd], self.at_last[above], np.where(has_above, m[odd], 0)), -1)
                use = keep_below >= keep_above
                run[odd] = np.where(use, below, above)
                q[odd] = np.where(use, self.first[below], self.last[above])
                at[odd] = np.where(use, self.at_first[below], self.at_last[above])
                m[odd] = np.minimum(m[odd], np.maximum(keep_below, keep_above))
            row[live] = self.to[run] + q - self.first[run]
            place[live], length[live] = at - 1, m + 1
            yield k, live, length[live], row[live]


def _ranked(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the keys (of ``width`` bits), equal ones by place, and dense ranks; key and place are sorted as one number where they fit."""
    n, bits = len(key), int(len(key)).bit_length()
    if width + bits <= 64:
        both = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        order, k = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        k = key[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])[:n]).astype(np.uint64)
    return order, rank


def earlier(strings: list[bytes], docs: np.ndarray) -> np.ndarray:
    """strings x SEEDS: the smallest document that has the SPAN bytes from each place of each string on; ``docs``: the smallest that has the string."""
    index = RunLengthIndex(strings, docs)
    out = np.full((len(strings), SEEDS), np.iinfo(np.int64).max)
    for k, live, length, row in index.matches():
        if k >= SPAN:
            hit = length >= SPAN
            out[live[hit], index.sizes[live[hit]] - k] = index.least[row[hit]]
    return out


def _marks(table: pa.Table) -> pa.Table:
    """One part of the strings: for each block's string, which windows are in a smaller document than its own, as bits. A block's own places pass."""
    part, blocks, out = table.column("key")[0].as_py(), table.column("block").to_pylist(), []
    if part < 0:
        return table
    asked = []
    for payload in table.column("payload").to_pylist():
        index, strings, low = unbundle(payload)
        asked.append((unpack_ints(index).astype(np.int64), unpack_strings(strings), unpack_ids(low)))
    index, low, strings = np.concatenate([a[0] for a in asked]), np.concatenate([a[2] for a in asked]), pa.concat_arrays([a[1] for a in asked])
    bits, bit = np.zeros(len(index), np.uint64), np.uint64(1) << np.arange(SEEDS, dtype=np.uint64)
    order = np.argsort(index, kind="stable")
    for _, at in by_range(index[order]):
        own = order[at]
        string, different = numbered(strings.take(pa.array(own)))
        least = np.full(len(different), np.iinfo(np.int64).max)
        np.minimum.at(least, string, low[own])
        before = earlier(different.to_pylist(), least)
        bits[own] = ((before[string] < low[own][:, None]) * bit).sum(axis=1, dtype=np.uint64)
    i = 0
    for b, a in zip(blocks, asked, strict=True):
        out.append((part, b, MARKS, pack_ints(bits[i : i + len(a[0])])))
        i += len(a[0])
    return pa.Table.from_batches([rows(out)])


def removed(data: np.ndarray, places: bytes | None, answers: dict[int, bytes]) -> np.ndarray:
    """Which bytes of a block go."""
    if places is None:
        return np.zeros(len(data), bool)
    start, count, string, least = (unpack_ints(x).astype(np.int64) for x in unbundle(places))
    bits = np.concatenate([unpack_ints(answers[k]) for k in sorted(answers)])[string]
    bits[least == 0] = (1 << SEEDS) - 1
    hit = np.zeros(len(data) + 1, np.int32)
    for k in range(SEEDS):
        hit[start[((bits >> np.uint64(k)) & np.uint64(1) > 0) & (count > k)] + k] = 1
    total = np.cumsum(hit)[: len(data)]
    total[SPAN:] -= total[: len(data) - SPAN].copy() if len(data) > SPAN else 0
    return total > 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept): the text without every byte that a string of SPAN bytes covers which also starts in a document with a smaller id.

    Ids are whole numbers; others are rejected. Texts are read in blocks, which are written once. Windows are dealt out by their seed: first the seeds' hashes
    alone, to find those in several documents, then the strings around shared seeds, each once a block with the smallest document that has
    it. In each part the different strings are indexed and matched; documents are compared there, so a passage that thousands of
    documents share is one string and one number a block. What goes back to a block is a bit for each window. A seed that more than ``hot``
    runs have, in different surroundings, would make one index grow with the corpus; its windows are dealt out one by one, by their own hashes.

    Null or empty text: no bytes. A long text is in one block, however long. Null id: smaller than all others. Repeated rows and rows with one id
    don't remove each other. Ties: of equal strings the smallest id keeps its own. Empty table: no rows. Other columns are left out, whatever their names.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col}: whole numbers are needed")
    texts = docs.select(F.monotonically_increasing_id().alias(ROW), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in text_batches(batch, 2, BLOCK_BYTES):
                payload = bundle(pack_text(b"".join(own), 5), pack_ints(np.array([len(t) for t in own])), pack_ids(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), pa.array([payload], pa.binary()), pa.array([sum(map(len, own))])], ["block", "payload", "bytes"])

    blocks = checkpointed(texts.mapInArrow(read, "block long, payload binary, bytes long"))
    layout = Layout.of(blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], hot)
    seen = checkpointed(blocks.select("block", "payload").mapInArrow(lambda it: _seeds(it, layout), MESSAGE).groupBy("key").applyInArrow(lambda t: _shared(t, hot), MESSAGE))
    release(docs)
    asked = blocks.select(F.lit(-1).cast("long").alias("key"), "block", F.lit(TEXT).alias("kind"), "payload")
    # The strings are the bulk of what moves, so they are shuffled once and not kept; only where they came from is.
    marks = checkpointed(asked.unionByName(seen).groupBy("block").applyInArrow(lambda t: _strings(t, layout), MESSAGE).groupBy("key").applyInArrow(_marks, MESSAGE))
    release(docs)

    def cut(table: pa.Table) -> pa.Table:
        answers, places, block = {}, None, None
        for key, kind, payload in zip(*[table.column(c).to_pylist() for c in ("key", "kind", "payload")], strict=True):
            if kind == TEXT:
                block = _block(payload)
            elif kind == PLACES:
                places = payload
            else:
                answers[key] = payload
        data, sizes, ids = block
        gone = removed(data, places, answers)
        out, a = [], 0
        for size, i in zip(sizes.tolist(), ids.tolist(), strict=True):
            own = gone[a : a + size]
            s, e = runs(own)
            out.append((None if i == -(1 << 63) else i, size, [{"first": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)], data[a : a + size][~own].tobytes()))
            a += size
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["id", "n_bytes", "spans", "kept"])

    return asked.unionByName(marks).groupBy("block").applyInArrow(cut, "id long, n_bytes long, spans array<struct<first: bigint, end: bigint>>, kept binary")


def query(docs: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return drop_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
