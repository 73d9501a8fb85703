"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import durable, fresh_path

__all__ = ["checked_broadcast", "durable", "fresh_path", "hot_join", "id_crc", "mixed", "pieces", "raw_bytes", "small_enough", "table"]

#: Rows that a checked broadcast may hold (an id and a few numbers each: well under 100 MB).
BROADCAST_ROWS = 2_000_000
#: A key with more than one in so many rows counts as hot; so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Bytes of text that a numpy kernel works on at a time, so that what it needs for them stays small.
CHUNK_BYTES = 1 << 18
#: Rows that one has at most, whatever their bytes: a row's number takes 16 bits.
CHUNK_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts df if it has at most so many rows; else it stays a plain side of a shuffled join."""
    return F.broadcast(df) if small_enough(df, most) else df


def hot_join(many: DataFrame, one: DataFrame, key: str, weight: str) -> DataFrame:
    """many joined with one, which has a row for each key and, as weight, the number of many's rows with it.

    Rows of hot keys stay where they are, as fewer than HOT_SHARE rows of one are broadcast to them; the others are shuffled. Both sides are read twice.
    """
    least = (one.agg(F.sum(weight)).first()[0] or 0) / HOT_SHARE
    hot, rest = F.broadcast(one.where(F.col(weight) > least)), one.where(F.col(weight) <= least)
    cold = many.join(hot.select(key), key, "left_anti").join(rest, key)
    return many.join(hot, key).select(*many.columns, *(c for c in one.columns if c != key)).unionByName(cold)


def id_crc(column: str) -> Column:
    """crc32 of an id's decimal text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


@cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _trim() -> None:
    """Free heap memory goes back to the system, where the C library can do that."""
    if _malloc_trim():
        _malloc_trim()(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece has at most so many rows, and one row or at most so many bytes in a text column. What the task took for them goes back to the system at its end, as
    workers outlive tasks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(total, base + most, side="right"))))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()
    _trim()


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and len + 1 offsets from 0; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
