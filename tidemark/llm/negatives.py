"""Hard negatives by stored angles: the triangle inequality bounds each score before it is computed."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.blocks import BLOCK, SAMPLE, SHARD, bounded_sample, exact, matrix, meet, one_each, scaled, usable
from tidemark.llm.common import checkpointed
from tidemark.llm.maxscore import best

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
REFERENCES = 16
ROUNDS = 8
#: Rows scored at a time, those with the highest upper bounds first.
STEP = 64


def directions(x: np.ndarray, count: int = REFERENCES, rounds: int = ROUNDS) -> np.ndarray:
    """Up to `count` unit vectors, near as many of `x` as possible: spherical k-means, begun far apart."""
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    u = x[norm > 0] / norm[norm > 0, None]
    if not len(u):
        return np.zeros((0, x.shape[1]))
    picked = [0]
    near = u @ u[0]
    while len(picked) < min(count, len(u)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        picked.append(far)
        near = np.maximum(near, u @ u[far])
    refs = u[picked]
    for _ in range(rounds):
        home = (u @ refs.T).argmax(axis=1)
        total = np.zeros_like(refs)
        np.add.at(total, home, u)
        size = np.sqrt((total ** 2).sum(axis=1, keepdims=True))
        refs = np.where(size > 1e-9, total / np.maximum(size, 1e-9), refs)
    return refs


def _angles(refs: dict[int, np.ndarray]):
    """Adds the norm of each vector and its angle to each reference direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, angles = [], []
            for v in batch.column("v").to_pylist():
                x = np.array(v, float)
                norm = float(np.sqrt(x @ x))
                r = refs.get(len(v), np.zeros((0, len(v))))
                norms.append(norm)
                angles.append(np.arccos(np.clip(r @ x / norm, -1, 1)).tolist() if norm else [np.pi / 2] * len(r))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64()), pa.array(angles, pa.list_(pa.float64()))], names=[*batch.schema.names, "norm", "angles"])

    return run


class Rows:
    """Rows of a shard by label, then id, with what their stored angles say."""

    def __init__(self, table: pa.Table, dim: int):
        self.table = table = table.take(pa.array(np.lexsort((table["vec_id"].to_numpy(), table["label"].to_numpy()))))
        self.ids = table["vec_id"].to_numpy()
        self.label = table["label"].to_numpy()
        self.x = matrix(table["v"], dim)
        self.norm = table["norm"].to_numpy()
        angles = table["angles"].combine_chunks()
        angles = angles.flatten().to_numpy(zero_copy_only=False).reshape(len(angles), -1)
        self.cos, self.sin = (np.ascontiguousarray(f(angles).T, np.float32) for f in (np.cos, np.sin))

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, side="right")))

    def bounds(self, anchor: "Rows", a: int, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the rows `at` can have with anchor `a`.

        An angle is at least the difference and at most the sum of the angles to a reference direction; the narrowest
        interval of all directions counts. Its cosines, times both norms, are widened by more than the rounding of
        angles and cosines can shift them.
        """
        size = anchor.norm[a] * self.norm[at]
        low, high = np.full(len(size), -1, np.float32), np.ones(len(size), np.float32)
        for r in range(len(self.cos)):
            c, s = anchor.cos[r, a] * self.cos[r, at], anchor.sin[r, a] * self.sin[r, at]
            np.maximum(low, c - s, out=low)
            np.minimum(high, c + s, out=high)
        slack = 2e-6 * size + 1e-2
        return np.ceil(size * low - slack), np.floor(size * high + slack)


def _reached(low: np.ndarray, k: int, least: float) -> float:
    """A score that k rows surely reach, given their lower bounds, or `least`."""
    return max(least, np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else least


def _positives(k: int):
    def solve(dim: int, anchors: pa.Table, rows: pa.Table) -> tuple:
        """The k best rows of each anchor's label in this shard.

        Rows whose upper bound stays below k lower bounds are never scored; the rows with the highest upper bounds come
        first and raise the threshold for the rest.
        """
        anchor, row = Rows(one_each(anchors, ["label"], dim), dim), Rows(one_each(rows, ["label"], dim), dim)
        q, x = exact(anchor.x, row.x)
        of, found, scores = [], [], []
        for a, (i, label) in enumerate(zip(anchor.ids.tolist(), anchor.label.tolist())):
            alike = row.of_label(label)
            low, high = row.bounds(anchor, a, alike)
            own = row.ids[alike] == i
            low[own] = high[own] = -np.inf
            at = np.flatnonzero(high >= _reached(low, k, np.finfo(float).min))
            if len(at) > STEP:
                lead = np.argpartition(high[at], len(at) - STEP)[-STEP:]
                reached = np.partition(x[alike.start + at[lead]] @ q[a], STEP - k)[STEP - k] if STEP >= k else -np.inf
                at = at[high[at] >= reached]
            at += alike.start
            score = (x[at] @ q[a]).astype(np.int64)
            first = best(score, row.ids[at], k)
            of.append(np.full(len(first), i))
            found.append(row.ids[at[first]])
            scores.append(score[first])
        return tuple(map(np.concatenate, (of, found, scores)))

    return solve


def _negatives(k: int, low: int, high: int):
    def solve(dim: int, anchors: pa.Table, rows: pa.Table) -> tuple:
        """For each anchor and positive, the k best rows of other labels in the positive's window in this shard.

        k rows whose bounds lie inside a window raise its lower end. A row is scored if its bounds overlap a window of
        the anchor, once for all of them.
        """
        anchor, row = Rows(one_each(anchors, ["label"], dim), dim), Rows(one_each(rows, ["label"], dim), dim)
        q, x = exact(anchor.x, row.x)
        out: list[list] = [[], [], [], [], []]
        for a, (i, label, positives) in enumerate(zip(anchor.ids.tolist(), anchor.label.tolist(), anchor.table["positives"].to_pylist())):
            floor, ceil = row.bounds(anchor, a, slice(None))
            floor[row.of_label(label)] = ceil[row.of_label(label)] = -np.inf  # inside no window
            windows = {p["score"]: (-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives}  # -(-a // b) rounds up
            asked = np.zeros(len(floor), bool)
            for least, most in windows.values():
                asked |= (floor <= most) & (ceil >= _reached(floor[(floor >= least) & (ceil <= most)], k, least))
            at = np.flatnonzero(asked)
            score = (x[at] @ q[a]).astype(np.int64)
            for p in positives:
                least, most = windows[p["score"]]
                inside = np.flatnonzero((score >= least) & (score <= most))
                first = inside[best(score[inside], row.ids[at[inside]], k)]
                for column, values in zip(out, (np.full(len(first), i), np.full(len(first), p["id"]), row.ids[at[first]], np.full(len(first), p["score"]), score[first])):
                    column.append(values)
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)

    return solve


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | str = "label", vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, references: int = REFERENCES, sample: int = SAMPLE,
                   shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor; higher ones come first,
    ties by smaller id. For each row where `anchors` holds, its positives are the first `positives` other rows of its
    label, and each positive's negatives the first `negatives` rows of other labels with low * positive <= 100 *
    negative <= high * positive. Fewer rows give fewer results; a window without a row (as of a positive below zero)
    gives none. No part take: rows without an id or a label, vectors that are null or hold a null or non-finite
    component (or one of 2^24 and more when scaled); vectors of unequal dimension never meet. Zero vectors score 0. Rows
    that share an id and a dimension are one row, the one with the least label, then vector. An empty table gives an
    empty result.

    Angles to `references` directions, fitted per dimension on `sample` rows, are stored with each vector. They only
    spare work: bounds hold for any directions, and each row whose bounds overlap a window is scored.
    """
    label = F.col(label) if isinstance(label, str) else label
    columns = [F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled(F.col(embedding), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked")]
    plain = vectors.where(usable(F.col(embedding), scale) & F.col(vec_id).isNotNull() & label.isNotNull()).select(*columns)
    refs = {d: directions(x, references) for d, (_, x) in bounded_sample(plain, "vec_id", "v", sample).items()}
    stored = checkpointed(plain.select("vec_id", "label", "asked", "v").mapInArrow(_angles(refs), "vec_id long, label long, asked boolean, v array<int>, norm double, angles array<double>"))
    rows, asked = stored.drop("asked"), stored.where("asked").drop("asked")
    near = meet(asked, rows, _positives(positives), "anchor long, id long, score long", shard, block)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asked = checkpointed(asked.join(chosen, F.col("vec_id") == F.col("anchor")).drop("anchor"))
    found = meet(asked, rows, _negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", shard, block)
    merged = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
