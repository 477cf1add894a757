"""Helpers that the operators share: row keys, stored tables, free column names, token arrays of Arrow batches."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators.numbering import shared_folder

#: Stands for a null doc_id while rows are joined; such rows come before all others.
NO_ID = -(2**63)
BLOCK_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- frames

def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a row: its id (null: before all ids) and a hash of its text, for ids that are not unique."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(text).alias("k_hash")]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local session without the setting gets a folder of its own."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: later jobs start from files, not from lineage,
    so a lost executor costs no recomputation of what lies before."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- token arrays

def byte_classes(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


SPACES = byte_classes((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; a null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with up to `limit` bytes, or one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every row the number of words before it (one more entry than rows).
    Words don't cross rows."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = is_word[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = off[:-1][off[:-1] < len(buf)]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial of its bytes, mixed with its length."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    longest = int((end - start).max())
    powers = np.cumprod(np.full(longest + 1, _P, np.uint64))
    sizes = end - start
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = (buf[np.repeat(start, sizes) + at].astype(np.uint64) + np.uint64(1)) * powers[at]
    sums = np.add.reduceat(terms, np.cumsum(sizes) - sizes)
    return mix(sums ^ (sizes.astype(np.uint64) << np.uint64(40)))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive symbols, built by doubling: log2(n) passes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, out_n, cur, size, k = None, 0, h, 1, n
    while k:
        if k & 1:
            if out is None:
                out, out_n = cur, size
            else:
                m = len(h) - out_n - size + 1
                out = out[:m] * _power(size) + cur[out_n : out_n + m]
                out_n += size
        k >>= 1
        if k:
            m = len(cur) - size
            cur = cur[:m] * _power(size) + cur[size : size + m]
            size *= 2
    return mix(out)


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values."""
    if len(h) < n:
        return h[:0]
    cur, size = h, 1
    while size * 2 <= n:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    rest = n - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
