"""Exact top-k inner products over postings by MaxScore."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.blocks import BLOCK, SAMPLE, SHARD, bounded_sample, exact, matrix, meet, one_each, scaled, usable

K = 10
SCALE = 1024
#: Non-essential terms probed at a time before rows that cannot compete any more are left out.
STEP = 8


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Postings:
    """Rows of a shard by term. A term is a dimension with a sign; its postings are the rows with components of that
    sign, its bound the largest of them. Rows ascend by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(x.T)
        self.above = [np.flatnonzero(c > 0) for c in self.columns]
        self.below = [np.flatnonzero(c < 0) for c in self.columns]
        self.high = np.maximum(x.max(axis=0), 0)
        self.low = np.minimum(x.min(axis=0), 0)

    def search(self, query_id: int, q: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows; `floor` is a score that k rows of the whole table reach, if known.

        Terms are ordered by what they can add at most. The last ones that together stay below the threshold are
        non-essential: a row without a posting in an essential term cannot reach it. Rows met in essential postings
        are scored there; the other terms are probed for rows that can still reach the threshold.
        """
        threshold = -np.inf if floor is None else floor
        most = np.where(q > 0, q * self.high, q * self.low)
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what terms from here on can add
        competitive = rest >= threshold
        essential = len(order) if competitive[-1] else int(np.argmin(competitive))
        if competitive[-1]:  # even a row without any posting can compete
            rows = np.arange(len(self.ids))
        else:
            met = np.zeros(len(self.ids), bool)
            for t in order[:essential].tolist():
                if most[t] > 0:
                    met[self.above[t] if q[t] > 0 else self.below[t]] = True
            rows = np.flatnonzero(met)
        rows = rows[self.ids[rows] != query_id]
        terms = order[:essential]
        score = q[terms] @ (self.columns[terms] if len(rows) == len(self.ids) else self.columns[np.ix_(terms, rows)])
        at = essential
        while at < len(order) and len(rows):
            if len(rows) > 4 * k:  # the rows that lead so far raise the threshold
                lead = np.argpartition(score, len(score) - k)[-k:]
                left = order[at:]
                full = score[lead] + q[left] @ self.columns[np.ix_(left, rows[lead])]
                threshold = max(threshold, full.min())
            keep = score + rest[at] >= threshold
            rows, score = rows[keep], score[keep]
            terms = order[at:at + STEP]
            score = score + q[terms] @ self.columns[np.ix_(terms, rows)]
            at += STEP
        first = best(score, self.ids[rows], k)
        return rows[first], score[first]


def _floors(sample: dict, k: int):
    """Adds to each query the k-th best score among the sampled rows: a bound that its k best rows surely reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors: list[int | None] = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                ids, x = sample.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)), np.int64)))
                a, b = exact(x, np.array(v, np.int64))
                score = (a @ b)[ids != i]
                floors.append(int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], names=[*batch.schema.names, "floor"])

    return run


def _search(k: int):
    def solve(dim: int, queries: pa.Table, rows: pa.Table) -> tuple:
        queries, rows = one_each(queries, [], dim), one_each(rows, [], dim)
        q, x = exact(matrix(queries["v"], dim), matrix(rows["v"], dim))
        postings = Postings(rows["vec_id"].to_numpy(), x)
        of, found, scores = [], [], []
        for i, v, floor in zip(queries["vec_id"].to_pylist(), q, queries["floor"].to_pylist()):
            place, score = postings.search(i, v, k, floor)
            of.append(np.full(len(place), i, np.int64))
            found.append(postings.ids[place])
            scores.append(score.astype(np.int64))
        return tuple(map(np.concatenate, (of, found, scores)))

    return solve


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE,
          shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `queries` holds, the k highest integer inner products.

    Components become floor(scale * x). Candidates are all rows but the query's own; ties go to smaller ids; with fewer
    than k candidates all are returned. No part take: rows without an id, vectors that are null or hold a null or
    non-finite component (or one of 2^24 and more when scaled, whose sums might leave a long); vectors of unequal
    dimension are no candidates of each other. Rows that share an id and a dimension are one row, the one with the least
    vector; the answers of one id are ranked together. An
    empty table gives an empty result.

    Each shard of rows answers each query by MaxScore; the shards' answers are merged. A query starts from the k-th
    best score among `sample` rows, which only spares work: the result is exact whatever the sample.
    """
    ok = usable(F.col(embedding), scale) & F.col(vec_id).isNotNull()
    rows = vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), scale).alias("v"))
    asked = vectors.where(ok & queries).select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), scale).alias("v"))
    asked = asked.mapInArrow(_floors(bounded_sample(rows, "vec_id", "v", sample), k), "vec_id long, v array<int>, floor long")
    found = meet(asked, rows, _search(k), "query_id long, vec_id long, score long", shard, block)
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
