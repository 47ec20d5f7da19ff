"""Shared helpers: folds, name clashes, lineage cuts, text buffers as numpy arrays."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.plans.session import materialized

SPACE = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 500_000


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of `spark.checkpoint.dir`."""
    return materialized(df)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def unit_hash(col: Column, seed: int) -> Column:
    """A column's hash as a number in [0, 1): one draw per value, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), col), 11) * F.lit(2.0 ** -53)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one uint8 array and int64 offsets (rows + 1); nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
