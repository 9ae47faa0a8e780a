"""Shared pieces of the training-data operators: scratch tables, Arrow batches and vectorised hashing of words.

Texts are handled as their UTF-8 bytes; a null text is an empty one. All hashes are fixed functions of the
content, so a task that is run again after an executor is lost gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.scratch import materialise, scratch_root  # noqa: F401

U = np.uint64
_MIX_A, _MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = U(0x9E3779B97F4A7C15)
_LONG_WORD = 4096
_SEGMENT = 1 << 20
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def discard(df: DataFrame) -> None:
    """Deletes a scratch table that is no longer read."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def content_id(text: Column) -> Column:
    """64-bit id of a text; equal texts share it, and two different ones collide with probability 2**-64."""
    return F.xxhash64(text)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * _MIX_A
    x ^= x >> U(27)
    x *= _MIX_B
    x ^= x >> U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def _pow_tables() -> list[np.ndarray]:
    if not _POW:
        n = _SEGMENT + 2 * _LONG_WORD
        _POW[:] = [_powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)]
    return _POW


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole values that together hold about `most` bytes; a longer value is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and for each value the index of its first word (n + 1 numbers)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    pos, inv = _pow_tables()
    codes = _BYTE_CODES[LOWER]
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    i, n = 0, len(starts)
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + _SEGMENT, side="left"))
        if len(long) and (k := np.searchsorted(long, i)) < len(long) and long[k] < j:
            if long[k] == i:
                word = LOWER[buf[starts[i] : ends[i]]].tobytes()
                out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                i += 1
                continue
            j = int(long[k])
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[buf[lo:hi]] * pos[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


_PLACES = (np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * U(2)) + U(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; with fewer words the whole sequence is one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        return mix(np.sum(words * _PLACES[:n], dtype=np.uint64, keepdims=True) + U(n))
    total = words[: n - width + 1] * _PLACES[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * _PLACES[k]
    return mix(total + U(width))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
