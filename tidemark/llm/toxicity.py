"""Toxicity by non-negative positive-unlabelled learning on hashed words."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import buffers, held_out, pieces, unit_hash
from tidemark.llm.hashing import mixed, prefix_hash, span_hash

BITS = 20
THRESHOLD = 0.3
LEAST_Z = 5.0
LEAST_SHARE = 0.02
STEMS = (4, 5, 6, 8)
#: A byte of a word: letters, digits and all of UTF-8's upper half; A-Z are lowered.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[65:91] = True
_IN_WORD[128:] = True


@dataclass(frozen=True)
class Classifier:
    """A linear model on the presence of hashed words: `buckets` sorted, their `weights`, and `bias`."""
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def word_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word of a piece of rows and of its beginnings of `STEMS` bytes, which stand for inflected
    forms; words never cross rows."""
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    cuts = np.unique(cuts[inside[cuts - 1] & inside[cuts]]) if len(cuts) else cuts  # a row that ends in a word before one that starts with one
    start = np.sort(np.concatenate((np.flatnonzero(edge == 1), cuts)))
    stop = np.sort(np.concatenate((np.flatnonzero(edge == -1), cuts)))
    row = np.searchsorted(at, start, side="right") - 1
    prefix = prefix_hash(_LOWER[data])
    rows, hashes = [row], [span_hash(prefix, start, stop)]
    for n in STEMS:
        long = stop - start > n
        rows.append(row[long])
        hashes.append(span_hash(prefix, start[long], start[long] + n) + np.uint64(n << 48))
    h = mixed(np.concatenate(hashes))
    return np.concatenate(rows), (h >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """positive, text -> positive and the distinct word buckets of the whole text."""
    for batch in batches:
        data, at = buffers(batch.column(1))
        for lo, hi in pieces(at):
            sub = at[lo:hi + 1] - at[lo]
            row, bucket = word_buckets(data[at[lo]:at[hi]], sub)
            both = np.unique(row << BITS | bucket)
            ends = np.searchsorted(both >> BITS, np.arange(hi - lo + 1))
            flat = pa.array((both & ((1 << BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=["positive", "words"])


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, keep: int = 4096, steps: int = 300, rate: float = 0.1, shrink: float = 1e-4) -> Classifier:
    """Minimise the non-negative PU risk of the logistic loss by Adam over the whole sample.

    Risk: prior * L+(P) + max(0, L-(U) - prior * L-(P)), where P are the positives and U the unlabelled rows. When the
    second part falls below zero, its gradient is walked backwards, as the estimator asks. Features are the buckets in
    three positives and 2 % of them, or more, whose presence differs by `LEAST_Z` standard errors between P and U, the
    `keep` best: words of one group of near copies are no evidence. The weights of the step with the least risk count,
    and the bias is then set so that the unlabelled rows score the prior on average (as they do at the minimum of the
    plain PU risk): with few positives, texts without evidence score below the prior, whatever the walk has done.
    """
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(p) or not len(u):
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    size = 1 << BITS

    def presence(which: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([rows[i] for i in which]), minlength=size)[:size]

    np_, nu = presence(p), presence(u)
    rate_p, rate_u = (np_ + 0.5) / (len(p) + 1), (nu + 0.5) / (len(u) + 1)
    pooled = (np_ + nu + 1) / (len(rows) + 2)
    z = np.abs(rate_p - rate_u) / np.sqrt(pooled * (1 - pooled) * (1 / len(p) + 1 / len(u)))
    z[np_ < max(3, LEAST_SHARE * len(p))] = 0
    buckets = np.sort(np.argsort(-z, kind="stable")[:keep])
    buckets = buckets[z[buckets] >= LEAST_Z]
    slot = np.full(size, -1, np.int64)
    slot[buckets] = np.arange(len(buckets))
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = slot[np.concatenate(rows)]
    which, cols = which[cols >= 0], cols[cols >= 0]
    w, m, v = (np.zeros(len(buckets) + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    least, chosen = np.inf, w
    for step in range(1, steps + 1):
        f = np.bincount(which, w[cols], minlength=len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        loss_neg = np.logaddexp(0, f)
        rest = loss_neg[u].mean() - prior * loss_neg[p].mean()
        risk = prior * np.logaddexp(0, -f[p]).mean() + max(0.0, rest) + shrink * prior / 2 * (w[:-1] @ w[:-1])
        if risk < least:
            least, chosen = risk, w
        pull = np.zeros(len(rows))
        if rest >= 0:
            pull[p] = prior * (s[p] - 1) / len(p) - prior * s[p] / len(p)
            pull[u] = s[u] / len(u)
        else:
            pull[p] = prior * s[p] / len(p)
            pull[u] = -s[u] / len(u)
        g = np.append(np.bincount(cols, pull[which], minlength=len(buckets)), pull.sum())
        g[:-1] += shrink * prior * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    f = np.bincount(which, chosen[cols], minlength=len(rows))[u]
    lo, hi = -60.0 - np.abs(f).max(), 60.0 + np.abs(f).max()
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 / (1 + np.exp(-np.clip(f + mid, -50, 50)))).mean() < prior else (lo, mid)
    return Classifier(buckets, chosen[:-1], float(lo))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, prior: float | None = None,
          doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Fit on the rows outside the held-out fold: confirmed positives, and texts of any kind as the unlabelled.

    `max_positive` and `max_unlabelled` bound the two samples (drawn by a hash of the id, so in expectation); only the
    samples' word buckets reach the driver. `prior` is the share of positives; by default that of the labelled rows of
    the training fold. Without a positive, every text scores the prior.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(~held_out() & F.col("doc_id").isNotNull())
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(~held_out() & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    n_pos, n_all = marks.agg(F.count_if(F.col("y") == 1), F.count(F.lit(1))).first()
    total = ids.select(F.count(F.lit(1))).first()[0]
    share = prior if prior is not None else (n_pos / n_all if n_all else 0.0)
    share = min(max(share, 1e-4), 1 - 1e-4)
    take_p, take_u = min(1.0, max_positive / max(n_pos, 1)), min(1.0, max_unlabelled / max(total, 1))
    known = marks.where((F.col("y") == 1) & (unit_hash(F.col("doc_id"), 7) < take_p)).select("doc_id").distinct()
    positives = ids.join(F.broadcast(known), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")  # about `max_positive` ids
    unlabelled = ids.where(unit_hash(F.col("doc_id"), 11) < take_u).select(F.lit(False).alias("positive"), "text")
    sample = positives.union(unlabelled).mapInArrow(_features, "positive boolean, words array<int>").toArrow()
    distinct = sorted({(bool(y), np.asarray(x.values, np.int32).tobytes()) for y, x in zip(sample["positive"].to_pylist(), sample["words"])})  # copies once, and the same sums in every run
    return fit_nnpu([np.frombuffer(x, np.int32) for _, x in distinct], np.array([y for y, _ in distinct], bool), share)


def score(docs: DataFrame, model: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` plus `name`, the probability that the whole text is toxic.

    Null and empty texts have no word and score what the bias alone gives. The model is a few thousand numbers.
    """
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{name}` double").fields])
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[model.buckets] = model.weights
        known = np.zeros(1 << BITS, bool)
        known[model.buckets] = True
        for batch in batches:
            data, at = buffers(batch.column(at_text))
            out = np.full(batch.num_rows, model.bias)
            for lo, hi in pieces(at):
                row, bucket = word_buckets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                hit = known[bucket]
                both = np.unique(row[hit] << BITS | bucket[hit])
                out[lo:hi] += np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], minlength=hi - lo)
            out = 1 / (1 + np.exp(-np.clip(out, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3 on) for every row, repeated rows and null ids too."""
    model = train(docs, labels, **options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
