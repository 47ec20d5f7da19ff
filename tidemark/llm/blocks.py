"""Whole-number vectors, and queries against all rows dealt out in units of bounded size."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import partitions

#: Scaled components from here on have no exact product sums in a long; such a vector takes no part.
LARGEST = 1 << 24
SHARD, BLOCK = 16_384, 16_384
SAMPLE, SAMPLE_BYTES = 2_048, 8 << 20


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, computed as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def usable(embedding: Column, scale: int) -> Column:
    """Neither null nor holding a null, non-finite or far too large component."""
    fits = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST - 1), F.lit(False)))
    return F.coalesce(fits, F.lit(False))


def bounded_sample(rows: DataFrame, vec_id: str, vector: str, size: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, by dimension, of at most `size` rows (and 8 MB) with the least hashes of their ids."""
    widest = rows.agg(F.max(F.size(vector))).first()[0]
    if not widest or widest < 1:
        return {}
    n = max(16, min(size, SAMPLE_BYTES // (4 * widest)))
    got: dict[int, dict[int, list[int]]] = {}
    for i, v in rows.select(vec_id, vector).orderBy(F.xxhash64(F.lit(7), vec_id), vec_id, vector).limit(n).collect():
        got.setdefault(len(v), {}).setdefault(i, v)
    return {d: (np.array(list(x), np.int64), np.array(list(x.values()), np.int64).reshape(len(x), d)) for d, x in got.items()}


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as one int64 matrix, a row per vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def one_each(table: pa.Table, by: list[str], dim: int) -> pa.Table:
    """Rows ascending by id; of rows that share one, the least by (`by`, vector) stays."""
    ids = table["vec_id"].to_numpy()
    if len(np.unique(ids)) == len(ids):
        return table.take(pa.array(np.argsort(ids, kind="stable")))
    keys = list(zip(ids.tolist(), *(table[c].to_pylist() for c in by), map(tuple, matrix(table["v"], dim).tolist()), range(len(ids))))
    best: dict[int, tuple] = {}
    for key in keys:
        if key[0] not in best or key < best[key[0]]:
            best[key[0]] = key
    return table.take(pa.array([best[i][-1] for i in sorted(best)], pa.int64()))


def exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where all product sums stay whole in them (then exact, and fast), else as they are."""
    most = x.shape[-1] * float(np.abs(x).max()) * float(np.abs(y).max()) if x.size and y.size else np.inf
    for kind, whole in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):
        if most < whole:
            return x.astype(kind), y.astype(kind)
    return x, y


def meet(queries: DataFrame, rows: DataFrame, solve: Callable, schema: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each block of queries meets each shard of rows in one call of `solve(dim, queries, rows)`.

    Both sides have vec_id and v (whole numbers) and whatever else `solve` needs; vectors of unequal dimension never
    meet. A unit holds about `block` queries and `shard` rows, whatever the data: rows are dealt by a hash of their id,
    so that equal vectors, hot labels and hot sources spread evenly. A row is sent once per block of queries, a query
    once per shard.
    """
    spark = rows.sparkSession
    shards, blocks = (max(1, math.ceil(x.count() / size)) for x, size in ((rows, shard), (queries, block)))
    n = max(partitions(spark), min(shards * blocks, 10_000))
    dim = F.size("v").alias("dim")
    keys = ["dim", "shard", "block"]

    def copies(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("*", dim, F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"), copies(shards).alias("shard"))
    right = rows.select("*", dim, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), copies(blocks).alias("block"))
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    form = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])

    def run(key: tuple, q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return form.empty_table()
        columns = solve(key[0].as_py(), q, r)
        return pa.table({c: pa.array(x, form.field(c).type) for c, x in zip(names, columns)}, schema=form)

    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, schema)
