"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.session import checkpoint_root

LAST_ID = (1 << 63) - 1


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which says in ``count`` how many rows each entry stands for.

    Keys with an entry of over a thousandth of all ``total`` rows, so a thousand at most, are
    broadcast with all their entries; the others are shuffled. ``keys`` are not null; a key
    has one entry, or one per text whose hashes collide.
    """
    hot = table.filter(F.col(count) * 1000 > total).select(*keys).distinct()
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    cold = rows.join(F.broadcast(hot), keys, "left_anti")
    rest = table.join(F.broadcast(hot), keys, "left_anti")
    return rows.join(few, keys).unionByName(cold.join(rest, keys, how))


def text_megabytes(docs: DataFrame) -> float:
    """Size of all texts, by which the number of hash buckets grows."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n
    return (total or 0) / 1e6


# ---- words of whole texts as numpy arrays, inside tasks ----

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[k : k + 1] = [np.cumprod(factors)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def released(batches):
    """``batches`` of a task; what Arrow holds of the earlier ones goes back to the system,
    as Python workers are kept and share their executor's memory."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def chunks(column: pa.Array, limit: int = 1 << 20):
    """(first row, bytes, offsets) of slices of about ``limit`` bytes; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES):
    """Starts and ends of the words of several texts, and each text's first word."""
    inside = ~gaps[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(starts)
    ends = np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; shorter by n - 1 than ``hashes``."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + size]
    return mixed(out)


def in_one_text(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which runs of ``n`` words, by first word, lie within one text."""
    ok = np.ones(max(0, count), dtype=bool)
    for end in np.unique(first[1:]):
        ok[max(0, end - n + 1) : end] = False
    return ok
