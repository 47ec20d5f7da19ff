"""Threshold regimes, structural breaks and regime-switching fits."""
from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.indicators import full_frame, runs
from tidemark.plans.ordered import over_rows, quantiles, row_index, running, stepwise
from tidemark.plans.session import materialized

KEYS = ("symbol",)


def threshold_variable(rets: DataFrame, kind: str = "volatility", delay: int = 1, window: int = 20, split=False) -> DataFrame:
    """`z`: level (running sum), change, or population std of the previous `window` returns, `delay` rows back."""
    df = rets
    if kind == "level":
        df = running(df, KEYS, ["ts"], {"_z": ("sum", F.col("ret"))}, split=split)
    elif kind == "change":
        df = df.withColumn("_z", F.col("ret"))
    else:
        def vol(w):
            f = w.rowsBetween(-window, -1)
            return {"_z": F.when(F.count("ret").over(f) == window, F.stddev_pop("ret").over(f))}
        df = over_rows(df, KEYS, ["ts"], window, vol, split=split)
    df = over_rows(df, KEYS, ["ts"], delay, lambda w: {"z": F.lag("_z", delay).over(w)}, split=split) if delay else df.withColumn("z", F.col("_z"))
    return df.where("z is not null").drop("_z")


def classify(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Regime = number of thresholds below z. cuts: symbol, thresholds array."""
    return df.join(cuts, "symbol").withColumn("regime", F.size(F.filter("thresholds", lambda t: F.col("z") > t))).drop("thresholds")


def quantile_thresholds(df: DataFrame, n_regimes: int, split=False) -> DataFrame:
    probs = {f"_t{i}": i / n_regimes for i in range(1, n_regimes)}
    return quantiles(df, ["symbol"], "z", probs, split=split).select("symbol", F.array(*probs).alias("thresholds"))


def _ll(n: Column, s: Column, ss: Column) -> Column:
    var = ss / n - (s / n) * (s / n)
    return F.when(var > 0, -n / 2 * (F.log(2 * math.pi * var) + 1)).otherwise(F.lit(0.0))


def grid_threshold(df: DataFrame, low: int = 10, high: int = 90, min_rows: int = 10, split=False) -> DataFrame:
    """Best single threshold among the percentiles low..high by Gaussian log-likelihood.

    Rows are counted once into the cells between candidates; below/above sums for every
    candidate come from running sums over at most 82 cells per symbol.
    """
    probs = {f"_p{i}": i / 100 for i in range(low, high + 1)}
    cand = quantiles(df, ["symbol"], "z", probs, split=split).select("symbol", F.array(*probs).alias("_c"))
    cell = df.join(cand, "symbol").withColumn("cell", F.size(F.filter("_c", lambda c: c < F.col("z"))))
    agg = cell.groupBy("symbol", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))
    grid = cand.select("symbol", F.posexplode("_c").alias("cell", "threshold"))
    full = grid.join(agg, ["symbol", "cell"], "left").na.fill(0, ["n", "s", "ss"])
    tot = agg.groupBy("symbol").agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "s", "ss")])
    w = Window.partitionBy("symbol").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    c = full.join(tot, "symbol").withColumns({f"b_{x}": F.sum(x).over(w) for x in ("n", "s", "ss")})
    up = {x: F.col(f"_{x}") - F.col(f"b_{x}") for x in ("n", "s", "ss")}
    c = c.withColumn("ll", _ll(F.col("b_n"), F.col("b_s"), F.col("b_ss")) + _ll(up["n"], up["s"], up["ss"]))
    ok = c.where((F.col("b_n") >= min_rows) & (up["n"] >= min_rows))
    return ok.groupBy("symbol").agg(F.max_by("threshold", F.struct("ll", -F.col("cell"))).alias("threshold"), F.max("ll").alias("log_likelihood"))


def parameters(df: DataFrame) -> DataFrame:
    out = df.groupBy("symbol", "regime").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"), F.count(F.lit(1)).alias("n"))
    tot = out.groupBy("symbol").agg(F.sum("n").alias("_t"))
    return out.join(tot, "symbol").withColumn("frequency", F.col("n") / F.col("_t")).drop("_t")


def information_criteria(params: DataFrame, n_regimes: int) -> DataFrame:
    """Log-likelihood, AIC, BIC of a threshold model from its regime parameters."""
    k = n_regimes * 2 + n_regimes - 1
    ll = F.sum(F.when(F.col("std") > 0, -F.col("n") / 2 * (F.log(2 * math.pi * F.col("std") * F.col("std")) + 1)).otherwise(0.0))
    out = params.groupBy("symbol").agg(ll.alias("log_likelihood"), F.sum("n").alias("n_obs"))
    return out.withColumns({"aic": -2 * F.col("log_likelihood") + 2 * k, "bic": -2 * F.col("log_likelihood") + F.log("n_obs") * k})


def regime_runs(df: DataFrame, keys=KEYS, state="regime", order=("ts",), split=False) -> DataFrame:
    x = runs(df, list(keys), F.col(state), order, split)
    return x.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def regime_summary(df: DataFrame, split=False) -> DataFrame:
    """Mean, volatility, persistence, duration 1/(1-p), frequency per regime."""
    nxt = over_rows(df, KEYS, ["ts"], 0, lambda w: {"_to": F.lead("regime").over(w)}, ahead=1, split=split)
    stay = nxt.where("_to is not null").groupBy("symbol", "regime").agg(F.avg((F.col("_to") == F.col("regime")).cast("double")).alias("persistence"))
    out = parameters(df).join(stay, ["symbol", "regime"], "left")
    p = F.coalesce("persistence", F.lit(1.0))
    return out.withColumns({"persistence": p, "duration": F.when(p < 1, 1 / (1 - p)).otherwise(F.lit(float("inf")))})


def regime_names(params: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("mean")
    last = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    r = F.row_number().over(w)
    return params.withColumn("name", F.when(r == 1, "Bear Market").when(r == last, "Bull Market").otherwise("Sideways Market"))


class ExpandingQuantile:
    """Interpolated quantile of all values so far: the lower part in one heap, the rest in another, so that a new value
    costs the logarithm of their number."""

    def __init__(self, p: float):
        self.p, self.low, self.high = p, [], []

    def add(self, x: float) -> float:
        if self.low and x < -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        at = (len(self.low) + len(self.high) - 1) * self.p
        want = int(at) + 1
        while len(self.low) < want:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        while len(self.low) > want:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        lo, part = -self.low[0], at - int(at)
        if part == 0 or self.high[0] == lo:
            return lo
        return (1 - part) * lo + part * self.high[0]


def pseudo_labels(rets: DataFrame, n: int = 20, split=False) -> DataFrame:
    """0 above the expanding 66% quantile of volatility, 2 above the expanding 33% of the mean, else 1.
    Rows before index n are 1. A quantile over all earlier rows is sequential: rows stream through their symbol's two
    pairs of heaps, which hold one bar series."""
    def back(w):
        f = w.rowsBetween(-(n - 1), 0)
        return {"vol": F.stddev_samp("ret").over(f), "avg": F.avg("ret").over(f)}

    x = over_rows(row_index(rets, KEYS, ["ts"], name="_at", split=split), KEYS, ["ts"], n - 1, back, split=split)
    live = F.col("_at") >= n
    x = x.withColumns({"vol": F.when(live, F.col("vol")), "avg": F.when(live, F.col("avg"))})

    def start():
        return ExpandingQuantile(0.66), ExpandingQuantile(0.33)

    def advance(state, vol, avg):
        if vol != vol or vol is None:
            return state, (1,)
        high, low = state[0].add(vol), state[1].add(avg)
        return state, (0 if vol > high else 2 if avg > low else 1,)

    keep = [c for c in x.columns if c != "_at"]
    return stepwise(x, KEYS, ["ts"], start, advance, ["vol", "avg"], keep, "label int")


def segment_cusum(x: DataFrame, seg: list[str], min_len: int) -> DataFrame:
    """Best break of each segment: position and statistic max |S_k| / sqrt(n var)."""
    st = x.groupBy(*seg).agg(F.avg("ret").alias("_m"), F.var_pop("ret").alias("_v"), F.count(F.lit(1)).alias("_n"), F.min("_rn").alias("_a"))
    j = x.join(st, seg).where(F.col("_n") - 1 >= 2 * min_len)
    w = Window.partitionBy(*seg).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("_rn") - F.col("_a")
    j = j.withColumn("_s", F.abs(F.sum(F.col("ret") - F.col("_m")).over(w)) / F.sqrt(F.col("_n") * F.col("_v")))
    j = j.where((k >= min_len) & (k < F.col("_n") - min_len))
    return j.groupBy(*seg).agg(F.max_by("_rn", F.struct("_s", -F.col("_rn"))).alias("break_at"), F.max("_s").alias("stat"))


def structural_breaks(rets: DataFrame, min_len: int = 20, critical: float = 1.36) -> DataFrame:
    """Recursive CUSUM splits, one pass per depth over all segments of all symbols, until none splits.
    Segments share their break row, so that row is copied into both halves."""
    x = materialized(row_index(rets, KEYS, ["ts"], split=False).select("symbol", "ts", "_rn", "ret").withColumn("seg", F.lit("")))
    found = None
    while True:
        hits = materialized(segment_cusum(x, ["symbol", "seg"], min_len).where(F.col("stat") > critical))
        if not hits.take(1):
            break
        found = hits if found is None else found.unionByName(hits)
        j = x.join(hits, ["symbol", "seg"])
        side = F.array_compact(F.array(F.when(F.col("_rn") <= F.col("break_at"), F.lit("0")), F.when(F.col("_rn") >= F.col("break_at"), F.lit("1"))))
        x = materialized(j.withColumn("_h", F.explode(side)).select("symbol", "ts", "_rn", "ret", F.concat("seg", "_h").alias("seg")))
    if found is None:
        return x.sparkSession.createDataFrame([], "symbol string, break_at long, stat double, depth int")
    return found.select("symbol", "break_at", "stat", F.length("seg").alias("depth"))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def _forward_backward(logb, loga, logpi, size):
    """Of many series at once, longest first: logb (time, series, state), loga (series, state, state), `size` their lengths."""
    al, be = np.zeros_like(logb), np.zeros_like(logb)
    al[0] = logpi + logb[0]
    at = [int((size > i).sum()) for i in range(len(logb))]  # series that reach a time stand in front
    for i in range(1, len(logb)):
        n = at[i]
        al[i, :n] = _lse(al[i - 1, :n, :, None] + loga[:n], 1) + logb[i, :n]
    for i in range(len(logb) - 2, -1, -1):
        n = at[i + 1]
        be[i, :n] = _lse(loga[:n] + (logb[i + 1, :n] + be[i + 1, :n])[:, None, :], 2)
    return al, be, _lse(al[size - 1, np.arange(len(size))], 1)


def _viterbi(logb, loga, logpi, size):
    d, back, each = logpi + logb[0], np.zeros(logb.shape, int), np.arange(len(size))
    for i in range(1, len(logb)):
        n = int((size > i).sum())
        c = d[:n, :, None] + loga[:n]
        back[i, :n] = c.argmax(1)
        d[:n] = c.max(1) + logb[i, :n]
    path = np.zeros(logb.shape[:2], int)
    path[size - 1, each] = d.argmax(1)
    for i in range(len(logb) - 2, -1, -1):
        n = int((size > i + 1).sum())
        path[i, :n] = back[i + 1, each[:n], path[i + 1, :n]]
    return path


def _em(emit, update, k: int, size: np.ndarray, max_iter: int, tol: float):
    """Shared expectation-maximization loop on log probabilities, over many series at once (longest first; `size`: lengths).

    `emit(at)` gives the log densities (time, series, state) of the series `at`, `update(at, gamma)` fits them to weights
    that are 0 past a series' end. A series leaves the loop when its likelihood stands.
    """
    a = np.full((len(size), k, k), 0.1 / max(k - 1, 1))
    a[:, np.arange(k), np.arange(k)] = 0.9 if k > 1 else 1.0
    pi, last, live = np.full((len(size), k), 1 / k), np.full(len(size), -np.inf), np.arange(len(size))
    for _ in range(max_iter):
        if not len(live):
            break
        n = size[live]
        logb, loga = emit(live), np.log(a[live] + 1e-300)
        al, be, ll = _forward_backward(logb, loga, np.log(pi[live] + 1e-300), n)
        inside = np.arange(len(logb))[:, None] < n
        gamma = np.where(inside[:, :, None], np.exp(al + be - ll[:, None]), 0.0)
        xi = np.zeros((len(live), k, k))
        for i in range(len(logb) - 1):
            m = int(inside[i + 1].sum())
            xi[:m] += np.exp(al[i, :m, :, None] + loga[:m] + (logb[i + 1, :m] + be[i + 1, :m])[:, None, :] - ll[:m, None, None])
        pi[live], a[live] = gamma[0] / gamma[0].sum(1, keepdims=True), xi / np.maximum(xi.sum(2, keepdims=True), 1e-300)
        update(live, gamma)
        on = ~(np.abs(ll - last[live]) < tol)
        last[live] = ll
        live = live[on]
    every = np.arange(len(size))
    logb, loga, logpi = emit(every), np.log(a + 1e-300), np.log(pi + 1e-300)
    al, be, ll = _forward_backward(logb, loga, logpi, size)
    return np.exp(al + be - ll[:, None]), _viterbi(logb, loga, logpi, size), a, ll


def fit_switching(rets: DataFrame, k: int = 2, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """Gaussian regime switching per symbol: smoothed probabilities, most likely path, parameters.

    Symbols run in parallel; one group is one bar series, bounded by the calendar. The start comes
    from quantile blocks of the sorted returns, so the fit is deterministic.
    """
    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts")
        x = f["ret"].to_numpy()
        parts = np.array_split(np.sort(x), k)
        mu, var = np.array([p.mean() for p in parts]), np.array([max(p.var(), x.var() / 10, 1e-6) for p in parts])

        def emit(_):
            return (-0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mu) ** 2 / var))[:, None]

        def update(_, g):
            w = np.maximum(g[:, 0].sum(0), 1e-300)
            mu[:] = (g[:, 0] * x[:, None]).sum(0) / w
            var[:] = np.maximum((g[:, 0] * (x[:, None] - mu) ** 2).sum(0) / w, 1e-6)

        g, path, a, ll = (v[:, 0] if i < 2 else v[0] for i, v in enumerate(_em(emit, update, k, np.array([len(x)]), max_iter, tol)))
        return pd.DataFrame({"symbol": f["symbol"], "ts": f["ts"], "ret": x, "regime": path.astype("int32"), "probs": list(g), "mean": mu[path],
                             "variance": var[path], "persistence": np.diag(a)[path], "log_likelihood": ll})

    return rets.select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(
        fit, "symbol string, ts timestamp, ret double, regime int, probs array<double>, mean double, variance double, persistence double, log_likelihood double")


#: Observations that a task of `fit_discrete` gathers, and padded cells (series x longest x k x k) of a round.
_GATHERED, _CELLS = 100_000, 1_000_000


def _discrete_round(x: list[np.ndarray], k: int, m: int, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities and states (time, series) and likelihoods of series of codes 0..m-1, longest first."""
    size = np.array([len(c) for c in x])
    code = np.full((size[0], len(x)), -1)
    for i, c in enumerate(x):
        code[:len(c), i] = c
    b = np.full((k, m), 1.0) + np.array([[0.5 if (j + i) % k == 0 else 0.0 for j in range(m)] for i in range(k)])
    b = np.repeat((b / b.sum(1, keepdims=True))[None], len(x), 0)

    def emit(at):
        top = int(size[at].max())
        return np.log(b[at[None, :], :, np.maximum(code[:top, at], 0)] + 1e-300)

    def update(at, g):
        new = np.stack([np.where((code[:len(g), at] == j)[:, :, None], g, 0.0).sum(0) for j in range(m)], 2)
        b[at] = new / np.maximum(new.sum(2, keepdims=True), 1e-300)

    g, path, _, ll = _em(emit, update, k, size, max_iter, tol)
    return g, path, ll


def fit_discrete(obs: DataFrame, k: int, symbols: list[str], max_iter: int = 30, tol: float = 1e-6) -> DataFrame:
    """Discrete hidden-state fit per entity: state path and probabilities. One observation per
    (entity, time bucket) keeps an entity bounded by the calendar; entities of like length are fitted together."""
    m = len(symbols)
    names = ["entity", "ts", "state", "probs", "log_likelihood"]

    def fit(t: pa.Table) -> pa.RecordBatch:
        code = pc.index_in(t.column("obs"), pa.array(symbols))
        if code.null_count:
            raise ValueError("an observation is not among the symbols")
        first = _begins(t.column("entity"))
        x, cut = code.to_numpy(), np.append(first, t.num_rows)
        order = np.argsort(-np.diff(cut), kind="stable")
        state, probs, likely = np.empty(t.num_rows, np.int32), np.empty((t.num_rows, k)), np.empty(t.num_rows)
        while len(order):
            n = max(1, _CELLS // (int(cut[order[0] + 1] - cut[order[0]]) * k * k))
            now, order = order[:n], order[n:]
            g, path, ll = _discrete_round([x[cut[e]:cut[e + 1]] for e in now], k, m, max_iter, tol)
            for i, e in enumerate(now):
                lo, hi = cut[e], cut[e + 1]
                state[lo:hi], probs[lo:hi], likely[lo:hi] = path[:hi - lo, i], g[:hi - lo, i], ll[i]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * k), pa.array(probs.ravel()))
        return pa.RecordBatch.from_arrays([t.column("entity").combine_chunks(), t.column("ts").combine_chunks(), pa.array(state), lists, pa.array(likely)], names=names)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = int(_begins(t.column("entity"))[-1]) if t.num_rows >= _GATHERED else 0
            if last:
                yield fit(t.slice(0, last))
            held = t.slice(last) if t.num_rows else None
        if held is not None:
            yield fit(held)

    rows = obs.repartition("entity").sortWithinPartitions("entity", F.asc_nulls_last("ts")).select("entity", "ts", "obs")
    return rows.mapInArrow(run, "entity long, ts timestamp, state int, probs array<double>, log_likelihood double")


def _begins(entity: pa.ChunkedArray) -> np.ndarray:
    """Places where another entity begins (nulls are one entity)."""
    e = entity.combine_chunks() if isinstance(entity, pa.ChunkedArray) else entity
    if not len(e):
        return np.zeros(0, np.int64)
    known, value = e.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(e, 0).to_numpy()
    return np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (known[1:] != known[:-1]))))


def vote(a: DataFrame, b: DataFrame, wa: float = 0.6, wb: float = 0.4) -> DataFrame:
    """Weighted vote of two (symbol, ts, regime, p) tables: best regime and its confidence."""
    j = a.join(b.withColumnRenamed("p", "_q"), ["symbol", "ts", "regime"], "full").select(
        "symbol", "ts", "regime", (wa * F.coalesce("p", F.lit(0.0)) + wb * F.coalesce("_q", F.lit(0.0))).alias("score"))
    return j.groupBy("symbol", "ts").agg(F.max_by("regime", F.struct("score", -F.col("regime"))).alias("regime"), F.max("score").alias("confidence"))
