"""Media columns: AVI files of motion JPEG, their frames and shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WIDTH, HEIGHT, FPS = 64, 16, 25
#: Lengths of the Huffman codes of the difference categories 0 to 8: 3 bits for the middle ones.
LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 4)
#: Bytes of text coded at a time, so that what is at hand stays in the processor's cache.
CHUNK = 1 << 18
#: A cut is a difference of histograms above the mean of the last WINDOW ones by SIGMAS deviations, and above LEAST.
BINS, WINDOW, SIGMAS, LEAST = 16, 8, 2.0, 0.25


class Frame(NamedTuple):
    """What a JPEG frame's header says, and where its coded data are."""

    width: int
    height: int
    restart: int
    huffman: tuple[bytes, bytes]
    data: int


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length): codes in order of length, then symbol."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


_CODES = _canonical(dict(enumerate(LENGTHS)))
_DHT = bytes([0]) + bytes([sum(n == k for n in LENGTHS) for k in range(1, 17)]) + bytes(sorted(range(9), key=lambda c: (LENGTHS[c], c)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Lossless JPEG (process 14, SOF3), 8 bits, one component, predictor 1 (left), a restart after each line.
JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, _DHT)
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0]))
    + _segment(0xDD, struct.pack(">H", WIDTH))
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the code with its additional bits, and its length."""
    codes, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, n = _CODES[c]
        codes[d + 255] = (code << c) | (d if d > 0 else d + (1 << c) - 1)
        lengths[d + 255] = n + c
    return codes, lengths


_CODE, _LENGTH = _difference_codes()


def encode_lines(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded lines, each with its marker (the next restart's, or the end of the image), one after the other, and their ends.

    ``samples``: lines x WIDTH, a multiple of HEIGHT of them.
    """
    lines = len(samples)
    diff = samples.astype(np.int64)
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    code, length = _CODE[diff], _LENGTH[diff]
    for _ in range(2):  # four codes in one, of 48 bits at most
        code, length = (code[:, ::2] << length[:, 1::2]) | code[:, 1::2], length[:, ::2] + length[:, 1::2]
    stop = np.cumsum(length, axis=1)
    size = (stop[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(size)])
    at = (base[:-1, None] << 3) + stop - length
    first = (at >> 3).ravel()
    value = (code << (56 - (at & 7) - length)).ravel()
    n = int(base[-1]) + 7
    packed = sum(np.bincount(first + k, weights=(value >> (48 - 8 * k)) & 255, minlength=n) for k in range(7)).astype(np.uint8)[: n - 7]
    packed[base[1:] - 1] |= ((1 << (size * 8 - stop[:, -1])) - 1).astype(np.uint8)  # padding with ones
    grown = 1 + (packed == 255)
    line = np.repeat(np.arange(lines), size)
    place = np.cumsum(grown) - grown + 2 * line
    ends = np.concatenate([[0], np.cumsum(grown)])[base[1:]] + 2 * np.arange(1, lines + 1)
    out = np.zeros(int(ends[-1]) if lines else 0, np.uint8)
    out[place] = packed
    out[ends - 2] = 255
    number = np.arange(lines) % HEIGHT
    out[ends - 1] = np.where(number == HEIGHT - 1, 0xD9, 0xD0 + number % 8)
    return out, ends


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], payload: int) -> bytes:
    """An AVI file of JPEG frames with an idx1 index; the chunk ``plen`` of its header list has the number of payload bytes."""
    head = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", head) + strl + _chunk(b"plen", struct.pack("<Q", payload)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose bytes, a multiple of WIDTH, are the samples; the last frame is filled with zeros."""
    frame = WIDTH * HEIGHT
    counts = [max(1, -(-len(p) // frame)) for p in payloads]
    coded, ends = encode_lines(np.frombuffer(b"".join(p.ljust(n * frame, b"\0") for p, n in zip(payloads, counts, strict=True)), np.uint8).reshape(-1, WIDTH))
    stops = ends.reshape(-1, HEIGHT)[:, -1].tolist()
    whole, out, k, start = coded.tobytes(), [], 0, 0
    for p, n in zip(payloads, counts, strict=True):
        frames = []
        for stop in stops[k : k + n]:
            frames.append(JPEG_HEAD + whole[start:stop])
            start = stop
        out.append(avi(frames, len(p)))
        k += n
    return out


def parse_avi(media: bytes) -> tuple[list[tuple[int, int]], int, int]:
    """Places (start, size) of the frames by the file's index, the payload's length (-1: none given), microseconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, stop, movi, index, payload, micros = 12, 8 + struct.unpack_from("<I", media, 4)[0], None, None, -1, 1_000_000 // FPS
    while at + 8 <= stop:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST":
            at += 12  # its chunks are read as ours
            continue
        elif name == b"idx1":
            index = (at + 8, size)
        elif name == b"plen":
            payload = struct.unpack_from("<Q", media, at + 8)[0]
        elif name == b"avih":
            micros = struct.unpack_from("<I", media, at + 8)[0] or micros
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    entries = np.frombuffer(media, "<u4", index[1] // 4, index[0]).reshape(-1, 4)
    video = (entries[:, 0] == int.from_bytes(b"00dc", "little")) | (entries[:, 0] == int.from_bytes(b"00db", "little"))
    # Offsets count from the list's kind, or in some files from the start of the file.
    base = movi if len(entries) and entries[0, 2] < movi else 0
    return [(base + o + 8, n) for o, n in entries[video][:, 2:].tolist()], payload, micros


@lru_cache(maxsize=64)
def _header(head: bytes) -> Frame:
    at, width, height, restart, table = 2, 0, 0, 0, None
    while True:
        if head[at] != 0xFF:
            raise ValueError("bad JPEG marker")
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC3:
            height, width = struct.unpack_from(">HH", body, 1)
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only frames of one component of 8 bits")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("only lossless JPEG with Huffman codes")
        elif marker == 0xC4:
            table = (body[1:17], body[17:])
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if body[3] != 1 or body[5] & 15:
                raise ValueError("only predictor 1 without point transform")
            break
        at += 2 + size
    if not (width and height and restart == width and table):
        raise ValueError("a restart after each line is needed")
    return Frame(width, height, restart, table, at + 2 + size)


@lru_cache(maxsize=16)
def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: length of the code with its additional bits (0: no code), and the difference."""
    counts, symbols = table
    length, diff = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            c = symbols[k]
            k += 1
            if n + c <= 16:
                lo, hi = code << (16 - n), (code + 1) << (16 - n)
                extra = (np.arange(lo, hi) >> (16 - n - c)) & ((1 << c) - 1)
                diff[lo:hi] = np.where(extra >> max(c - 1, 0), extra, extra - (1 << c) + 1) if c else 0
                length[lo:hi] = n + c
            code += 1
        code <<= 1
    return length, diff


def decode_frames(media: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
    """Of each file: its frames' samples (frames x height x width), payload length, microseconds a frame.

    All lines of all files with equal headers are decoded side by side, one sample of each at a time.
    """
    places = [parse_avi(m) for m in media]
    groups: dict[Frame, list[tuple[int, int]]] = {}
    parts: dict[Frame, list[bytes]] = {}
    for k, (m, (frames, _, _)) in enumerate(zip(media, places, strict=True)):
        for j, (start, size) in enumerate(frames):
            end = m.index(b"\xff\xda", start)
            end += 2 + struct.unpack_from(">H", m, end + 2)[0]
            head = _header(m[start:end])
            groups.setdefault(head, []).append((k, j))
            parts.setdefault(head, []).append(m[end : start + size])
    out = [[None] * len(frames) for frames, _, _ in places]
    for head, owners in groups.items():
        data = np.frombuffer(b"".join(parts[head]), np.uint8)
        mark = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0))
        stuffed = np.flatnonzero((data[:-1] == 255) & (data[1:] == 0)) + 1
        if len(mark) != head.height * len(owners):
            raise ValueError("lines are missing")
        drop = np.zeros(len(data), bool)
        drop[stuffed] = drop[mark] = drop[mark + 1] = True
        kept = np.cumsum(~drop)
        pure = np.concatenate([data[~drop], np.full(4, 255, np.uint8)]).astype(np.uint32)
        windows = (pure[:-3] << 24) | (pure[1:-2] << 16) | (pure[2:-1] << 8) | pure[3:]
        starts = np.concatenate([[0], kept[mark[:-1]]])
        length, diff = _lookup(head.huffman)
        at = starts.astype(np.int64) << 3
        got = np.empty((head.width, len(at)), np.int32)
        for i in range(head.width):
            bits = (windows[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF
            got[i] = diff[bits]
            step = length[bits]
            if not step.all():
                raise ValueError("bad code")
            at += step
        samples = ((np.cumsum(got, axis=0) + 128) & 0xFFFF).astype(np.uint8).T.reshape(len(owners), head.height, head.width)
        for (k, j), s in zip(owners, samples, strict=True):
            out[k][j] = s
    return [(np.stack(frames) if frames else np.zeros((0, HEIGHT, WIDTH), np.uint8), payload, micros) for frames, (_, payload, micros) in zip(out, places, strict=True)]


def cuts(frames: np.ndarray) -> np.ndarray:
    """Numbers of the frames that begin a shot, 0 among them.

    The difference of two frames is half the sum of absolute differences of their histograms; it is a cut above LEAST and above
    mean + SIGMAS x deviation of the WINDOW differences before it.
    """
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    flat = frames.reshape(n, -1)
    bins = (flat >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS) / flat.shape[1]
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(n - 1)
    lo = np.maximum(i - WINDOW, 0)
    m = np.maximum(i - lo, 1)
    mean = (s1[i] - s1[lo]) / m
    dev = np.sqrt(np.maximum((s2[i] - s2[lo]) / m - mean**2, 0))
    return np.concatenate([[0], np.flatnonzero((d > LEAST) & (d > mean + SIGMAS * dev)) + 1])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's bytes, filled with zeros to a positive multiple of WIDTH, as an AVI file.

    Null text: as empty.  A long text is one file of as many frames as it fills.  Null ids and repeated rows: a row each.  Ties: equal texts, equal files.  Empty
    table: no rows.  Other columns are left out, whatever their names.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_batches(batch, 1, CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encode([padded(t) for t in texts]), pa.binary())], ["id", "media"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(store, f"id {docs.schema[id_col].dataType.simpleString()}, media binary")


def padded(text: bytes) -> bytes:
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")


def clips(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, clip, first_frame, n_frames, start_s, end_s): a row for each shot of each AVI file.

    Null media: no rows.  A file that can't be read (an empty one, say): one row with clip -1, no times.  Long files: read whole.  Null ids pass through.  Repeated
    rows: rows for each.  Ties: none, frames have an order.  Empty table: no rows.  Other columns are left out.
    """
    kind = media.schema[id_col].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                try:
                    ((frames, _, micros),) = decode_frames([m])
                except (ValueError, IndexError, struct.error):
                    rows.append((k, -1, None, None, None, None))
                    continue
                at = cuts(frames).tolist()
                rows += [(k, c, x, y - x, x * micros / 1e6, y * micros / 1e6) for c, (x, y) in enumerate(zip(at, [*at[1:], len(frames)], strict=True))]
            names, types = ["id", "clip", "first_frame", "n_frames", "start_s", "end_s"], [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(split, f"id {kind.simpleString()}, clip long, first_frame long, n_frames long, start_s double, end_s double")


def digest(texts: list[bytes]) -> list[tuple[int, int, str, int, int, str, str]]:
    """Of each text: what the query returns, from its stored file read back."""
    files = encode([padded(t) for t in texts])
    out = []
    for t, f, (frames, payload, micros) in zip(texts, files, decode_frames(files), strict=True):
        back = frames.tobytes()[:payload]
        at = cuts(frames).tolist()
        shots = " ".join(f"{x * micros / 1e6:g}-{y * micros / 1e6:g}" for x, y in zip(at, [*at[1:], len(frames)], strict=True))
        out.append((len(t), payload, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), f"{len(frames)} frames; {len(at)} shots: {shots}"))
    return out


def query(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for a, b, texts in text_batches(batch, 1, CHUNK):
                rows = digest(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(make, schema)
