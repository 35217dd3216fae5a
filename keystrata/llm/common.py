"""Byte-level text helpers shared by the training-data operators.

Tasks see text as Arrow string columns. `blocks` cuts a batch into runs of whole rows of about
one megabyte, so the numpy temporaries of a task stay small whatever the batch holds; one very
long text is a block of its own.
"""

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import filesystem, shared_dir, written  # noqa: F401

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 50_000
BROADCAST_ROWS = 500_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def byte_table(excluded: bytes) -> np.ndarray:
    """Which byte values belong to a word, for words made of everything but `excluded`."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of an Arrow string or binary array; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    elif column.type in (pa.string(), pa.binary()):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        if np.any(np.diff(offsets)[~valid]):  # bytes behind a null row are not part of it
            return string_bytes(column.fill_null(""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yields (first row, end row, bytes, row offsets from 0), each of at most `limit` bytes or one row."""
    data, offsets = string_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n, row + BLOCK_ROWS)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse modulo 2^64, at least n of them."""
    if _powers.get("n", 0) < n:
        size = max(n, BLOCK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any span of `data`."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [begin, end): equal bytes, equal hashes, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """(begin, end, row) of every maximal run of member bytes; runs do not cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    w = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets[1:], begin, side="right")


def written_for_joins(df: DataFrame, name: str, *columns: str, codec: str = "zstd") -> DataFrame:
    """Like `written`, dealt into buckets by `columns`: joins on them then move only the other side.

    The buckets are as many as shuffles have partitions, so rows that come from a shuffle on the
    same columns are written where they are."""
    spark = df.sparkSession
    called = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", codec).option("path", shared_dir(spark, name))
    writer.bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(called)
    return spark.table(called)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few columns, to be broadcast while it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def task_name() -> str:
    """A name that no other attempt of any task has."""
    return f"{uuid.uuid4().hex}-{os.getpid()}"
