"""Shared helpers: columns, row identity, checkpoints and packed integers."""

from __future__ import annotations

import gc
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.plans.storage import checkpointed  # noqa: F401  (for the operators)

#: The bytes 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Names of our own columns: a row's number, what it is known by, and all of its columns in a struct.
ROW, KEY, ALL = "__tl_row", "__tl_key", "__tl_all"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files behind what has been written to the checkpoint folder.

    Twice: what Python lets go is detached in the JVM only after the first round.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(c, UPPER, LOWER)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def hash_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def hash_bound(share: float) -> int | None:
    """What a 64-bit hash (signed) has to be below in a share of all cases, however small; None: all of them."""
    return None if share >= 1 else int(share * 2.0**64) - (1 << 63)


def sampled(id_col: str, share: float) -> Column:
    """Whether a row is in a sample of this share, chosen by a hash of its id."""
    bound = hash_bound(share)
    return F.lit(True) if bound is None else F.xxhash64(id_col) < F.lit(bound)


def text_key(id_col: str | None, text: Column) -> Column:
    """What a row is known by when its table is read again: its id, if any, and the MD5 of its text (null: as empty). Row numbers would depend on how the table is cut into partitions."""
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("text")
    return F.struct(*([] if id_col is None else [F.col(id_col).alias("id")]), digest)


def with_columns(docs: DataFrame, row: str, new: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, those named as in ``new`` replaced, then ``new``."""
    names = {n.lower() for n in new}
    return [F.col(row)[c].alias(c) for c in docs.columns if c.lower() not in names] + [c.alias(n) for n, c in new.items()]


def pack_ints(a: np.ndarray, ordered: bool = False) -> bytes:
    """Unsigned integers, as differences where ``ordered``, by planes of bytes, compressed."""
    import zstandard

    a = np.ascontiguousarray(a, dtype=np.uint64)
    if ordered and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    width = 1 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width, ordered]) + len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    import zstandard

    width, ordered, n = b[0], b[1], int.from_bytes(b[2:10], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[10:], max_output_size=n * width), np.uint8)
        out[:, :width] = planes.reshape(width, n).T
    a = out.reshape(-1).view("<u8").astype(np.uint64)
    return np.cumsum(a, dtype=np.uint64) if ordered else a


def strings_array(text: np.ndarray | bytes, sizes: np.ndarray) -> pa.Array:
    """Strings of these sizes, one after the other in ``text``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(text)])


def numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each string's number among the different ones, which are compared byte by byte, and these."""
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def pack_text(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return len(data).to_bytes(8, "little") + zstandard.ZstdCompressor(level=level).compress(data)


def unpack_text(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b[8:], max_output_size=int.from_bytes(b[:8], "little")) if b[:8] != bytes(8) else b""


def pack_strings(strings: pa.Array) -> bytes:
    """Binary strings, a slice of an array perhaps."""
    edges = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    return bundle(pack_ints(np.diff(edges)), pack_text(memoryview(strings.buffers()[2])[edges[0] : edges[-1]] if edges[-1] > edges[0] else b""))


def unpack_strings(b: bytes) -> pa.Array:
    sizes, text = unbundle(b)
    return strings_array(unpack_text(text), unpack_ints(sizes).astype(np.int64))


def bundle(*parts: bytes) -> bytes:
    """Several byte strings in one."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundle(b: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i : i + 8], "little")
        out.append(b[i + 8 : i + 8 + n])
        i += 8 + n
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, 1 << 16)
        p = np.full(m, _BASE, np.uint64)
        p[0] = 1
        q = np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of ``data`` (bytes), through one prefix sum.

    A polynomial in an odd base modulo 2^64, whose powers have inverses, mixed with the length. Good for dealing out and for buckets; it
    doesn't tell strings apart, as texts that are made for it collide.
    """
    p, q = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64, out=s[1:])
    h = (s[ends] - s[starts]) * q[starts]
    return mix64(h ^ mix64((ends - starts).astype(np.uint64)))


#: By byte: what it is after A-Z are lower-cased; whether it is a space; whether it is part of a word of [0-9A-Za-z] and non-ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[65:91] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def crc(x: object) -> int:
    return zlib.crc32(str(x).encode() if x is not None else b"")


def text_batches(batch, column: str | int, limit: int = 4 << 20):
    """Slices of an Arrow batch with about ``limit`` bytes of text each, one row at least: (first row, end row, texts as bytes)."""
    col = batch.column(column).cast(pa.large_binary())
    n, first, size, texts = len(col), 0, 0, []
    for i in range(n):
        t = col[i].as_py() or b""
        if texts and size + len(t) > limit:
            yield first, i, texts
            first, size, texts = i, 0, []
        texts.append(t)
        size += len(t)
    if texts:
        yield first, n, texts
