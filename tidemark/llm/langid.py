"""Language identification by error-correcting output codes over hashed byte n-grams."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import buffers, held_out, pieces, unit_hash
from tidemark.llm.hashing import gram_hash, mixed, prefix_hash

BITS = 12
GRAMS = (2, 3)
UNKNOWN = "und"
#: Bytes that make a gram: letters of ASCII and UTF-8's upper half; all others become a space.
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Codes:
    """`codewords` (languages x bits, +-1), a weight row per bit (`weights`, `bias`) and the loss weights."""
    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    loss_weights: np.ndarray


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """All 2^(k-1) - 1 different splits up to seven languages, else the best of random codes by least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        cols = [(1, *rest) for rest in product((-1, 1), repeat=k - 1) if -1 in rest]
        return np.array(cols, float).T
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, far = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, n))
        code[0, np.abs(code.sum(axis=0)) == k] *= -1
        least = ((n - code @ code.T) / 2 + n * np.eye(k)).min()
        if least > far:
            best, far = code, least
    return best


def gram_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x 2^BITS shares of hashed n-grams, as square roots; grams stay inside their row. No gram: zeros."""
    out = np.zeros((len(at) - 1, 1 << BITS), np.float32)
    prefix = prefix_hash(_CLEAN[data])
    hashed = [(mixed(gram_hash(prefix, n)) >> np.uint64(64 - BITS)).astype(np.int64) for n in GRAMS]
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for n, h in zip(GRAMS, hashed):
            if b - a >= n:
                out[i] += np.bincount(h[a:b - n + 1], minlength=1 << BITS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def _rows(column: pa.Array, rows: int = 256) -> Iterator[np.ndarray]:
    data, at = buffers(pc.utf8_lower(column))
    for lo, hi in pieces(at):
        for a in range(lo, hi, rows):
            b = min(a + rows, hi)
            yield gram_counts(data[at[a]:at[b]], at[a:b + 1] - at[a])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for x in _rows(batch.column(1)):
            used = [np.flatnonzero(r) for r in x]
            ends = np.cumsum([0, *map(len, used)]).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(used).astype(np.int16)))
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[u] for r, u in zip(x, used)]).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(x)), slots, values], names=["lang", "slots", "shares"])
            done += len(x)


def fit_codes(x: np.ndarray, lang: list[str], steps: int = 200, rate: float = 2.0, shrink: float = 1e-5) -> Codes:
    """One logistic classifier per bit (full-batch Adam on centred shares), each language weighing the same.

    The loss weight of (language, bit) is the share of that language's rows whose bit is predicted right, and the
    weights of a language sum to 1: a bit that fails on a language says little about it.
    """
    names = sorted(set(lang))
    code = codewords(len(names))
    of = np.searchsorted(names, lang)
    weight = 1.0 / (np.bincount(of, minlength=len(names))[of] * len(names))
    target = code[of]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        f = x @ w + b
        pull = -target / (1 + np.exp(np.clip(target * f, -50, 50))) * weight[:, None]
        gw, gb = x.T @ pull + shrink * w, pull.sum(axis=0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        w -= rate * fix * mw / (np.sqrt(vw) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    right = ((x @ w + b) * target > 0).astype(float)
    loss_weights = np.array([right[of == i].mean(axis=0) + 1e-9 for i in range(len(names))])
    return Codes(names, code, w.astype(np.float32), b, loss_weights / loss_weights.sum(axis=1, keepdims=True))


def decode(codes: Codes, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding of margins (rows x bits): nearest codeword, its share of exp(-loss), lead over the next.

    The loss of a language is the weighted mean over bits of log(1 + exp(-codeword * margin)). Equal losses go to the
    first language by code point.
    """
    loss = np.einsum("rlb,lb->rl", np.logaddexp(0, -np.clip(f, -30, 30)[:, None, :] * codes.codewords[None]), codes.loss_weights)
    power = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * codes.codewords.shape[1])
    best = loss.argmin(axis=1)
    score = power.max(axis=1) / power.sum(axis=1)
    ordered = np.sort(loss, axis=1)
    lead = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, score, lead


def train(docs: DataFrame, rows_per_language: int = 400, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Codes | None:
    """Fit on rows outside the held-out fold with a language: about `rows_per_language` of each, drawn by a hash of the id.

    Only the sample's gram shares reach the driver. Without a row to learn from there are no codes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, rows_per_language / n))]), F.col("lang"))
    drawn = rows.where(F.coalesce(unit_hash(F.col("doc_id"), 3), F.lit(0.0)) < share).select("lang", "text")
    sample = drawn.mapInArrow(_sample, "lang string, slots array<short>, shares array<float>").toArrow()
    got = sorted((l, np.asarray(s.values, np.int64).tobytes(), np.asarray(v.values, np.float32).tobytes()) for l, s, v in zip(sample["lang"].to_pylist(), sample["slots"], sample["shares"]))
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, (_, s, v) in enumerate(got):
        x[i, np.frombuffer(s, np.int64)] = np.frombuffer(v, np.float32)
    return fit_codes(x, [g[0] for g in got]) if got else None


def identify(docs: DataFrame, codes: Codes | None, doc_id: str = "doc_id", text: str = "text", lead: float = 0.1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row, from the whole text alone.

    Texts that are null or hold no letter get `und` with score 0 (not ambiguous), and so do all without codes. A text
    is ambiguous when the nearest codeword's loss is less than `lead` below the next one's.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if codes is None:
        return source.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*codes.languages, UNKNOWN], object)
        for batch in batches:
            known = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            found = [decode(codes, x @ codes.weights + codes.bias) for x in _rows(batch.column(1))]
            best, score, ahead = (np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0))
            best = np.where(known, best, len(codes.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & (ahead < lead))], names=schema.names)

    return source.mapInArrow(run, schema).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
