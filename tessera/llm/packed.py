"""Arrays of many small things as compressed cells of one row, so that an exchange moves few rows."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import words as W
from .shared import materialize


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, of as few bytes as the greatest needs, compressed; all first bytes come first, then all second ones."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or x.max() < 1 << 8 * w)
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loosened(raw: bytes, kind=np.int64) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(kind)


def column(table: pa.Table, name: str, kind=np.int64) -> list[np.ndarray]:
    return [loosened(x, kind) for x in table.column(name).to_pylist()]


def ascending(x: np.ndarray) -> bytes:
    """Unsigned whole numbers in ascending order, by their differences."""
    return squeezed(np.diff(x, prepend=np.zeros(1, np.uint64)))


def ascended(raw: bytes) -> np.ndarray:
    return np.cumsum(loosened(raw).view(np.uint64), dtype=np.uint64)


def chosen(x: np.ndarray) -> tuple[bytes, bytes]:
    """Signed whole numbers of which few are distinct: these, and which of them each is."""
    kinds, which = np.unique(x, return_inverse=True)
    return kinds.astype("<i8").tobytes(), squeezed(which)


def taken(kinds: bytes, which: bytes) -> np.ndarray:
    return np.frombuffer(kinds, "<i8")[loosened(which)]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash."""
    if buckets == 1:
        return np.zeros(len(hashes), np.int64)
    return (hashes // np.uint64(((1 << 64) + buckets - 1) // buckets)).astype(np.int64)


def runs_of(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of the rows of each bucket that has some."""
    return [(int(sorted_buckets[i]), int(i), int(j)) for i, j in zip(*W.runs(sorted_buckets))]


def record(schema: pa.Schema, rows: list[tuple], of=pa.RecordBatch):
    """Rows, filled up with nulls on the right."""
    rows = [(*r, *[None] * (len(schema) - len(r))) for r in rows]
    return of.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the queries that run inside go with each query."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Materialize df; its shuffle files go with the query."""
    with tidy(df.sparkSession):
        return materialize(df, label)
