"""States, transition tables and chain arithmetic on long tables."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import edge_bin
from tidemark.plans.ordered import over_rows, quantiles, row_index


def quantile_states(df: DataFrame, col: str, n: int, keys=("symbol",), split=None) -> DataFrame:
    """State 0..n-1 by n+1 quantile edges; the last bin is closed."""
    probs = {f"_e{i}": i / n for i in range(n + 1)}
    e = quantiles(df, list(keys), col, probs, split=split)
    e = e.select(*keys, F.array(*probs).alias("_edges"))
    return df.join(e, list(keys)).withColumn("state", edge_bin(F.col(col), F.col("_edges"))).drop("_edges")


def state_moments(df: DataFrame, col: str, keys=("symbol",)) -> DataFrame:
    n = F.count(col)
    sd = F.when(n > 1, F.stddev_pop(col)).otherwise(F.lit(0.1))
    return df.groupBy(*keys, "state").agg(F.avg(col).alias("mean"), F.greatest(sd, F.lit(1e-6)).alias("std"), n.alias("n"))


def nearest_states(df: DataFrame, centers: DataFrame, col: str, keys=("symbol",)) -> DataFrame:
    """Closest center by |x - mean|, the lowest state on ties. Centers: keys, state, mean (a few rows per key)."""
    packed = centers.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("state", "mean"))).alias("_c"))
    d = F.transform("_c", lambda c: F.struct(F.abs(F.col(col) - c["mean"]).alias("d"), c["state"].alias("state")))
    return df.join(packed, list(keys)).withColumn("state", F.array_min(d)["state"]).drop("_c")


def grid_states(df: DataFrame, cols: list[str], bins: int, keys=("symbol",), split=None) -> DataFrame:
    """One state per cell of the per-dimension quantile grid."""
    out, code = df, F.lit(0)
    for i, c in enumerate(cols):
        out = quantile_states(out, c, bins, keys, split).withColumnRenamed("state", f"_g{i}")
        code = code + F.col(f"_g{i}") * bins ** i
    return out.withColumn("state", code.cast("int")).drop(*[f"_g{i}" for i in range(len(cols))])


def mahalanobis_states(df: DataFrame, cols: list[str], keys=("symbol",), ridge: float = 1e-6) -> DataFrame:
    """Reassign rows to the state with the smallest Mahalanobis distance; needs a `state` column.
    State means and inverse covariances are one small row per state."""
    d = len(cols)
    stats = df.groupBy(*keys, "state").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields if f.name in (*keys, "state"))

    def invert(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                cov = np.array([[getattr(r, f"c{i}_{j}") for j in range(d)] for i in range(d)]) + ridge * np.eye(d)
                rows.append((*[getattr(r, k) for k in keys], r.state, [getattr(r, f"m{i}") for i in range(d)], list(np.linalg.inv(cov).ravel())))
            yield pd.DataFrame(rows, columns=[*keys, "state", "mean", "inv"])

    inv = stats.mapInPandas(invert, f"{kinds}, mean array<double>, inv array<double>")
    packed = inv.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("state", "mean", "inv"))).alias("_s"))

    def dist(s):
        dev = [F.col(c) - s["mean"][i] for i, c in enumerate(cols)]
        total = F.lit(0.0)
        for i in range(d):
            for j in range(d):
                total = total + dev[i] * dev[j] * s["inv"][i * d + j]
        return F.struct(total.alias("d"), s["state"].alias("state"))

    return df.drop("state").join(packed, list(keys)).withColumn("state", F.array_min(F.transform("_s", dist))["state"]).drop("_s")


def kmeans_states(df: DataFrame, cols: list[str], k: int, seed: int = 7, mixture: bool = False) -> DataFrame:
    """Spark ML k-means or Gaussian mixture over all rows."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=cols, outputCol="_x").transform(df)
    model = (GaussianMixture if mixture else KMeans)(featuresCol="_x", predictionCol="state", k=k, seed=seed).fit(x)
    return model.transform(x).select(*df.columns, "state")


def _steps(df: DataFrame, order: int, keys, seq, state: str, split) -> DataFrame:
    def build(w):
        return {"history": F.array(*[F.lag(state, k).over(w) for k in range(order, 0, -1)])}
    return over_rows(df, keys, list(seq), order, build, split=split).where(F.col("history")[0].isNotNull())


def transition_counts(df: DataFrame, order: int = 1, keys=("entity",), seq=("ts",), state: str = "state", by=(), split=None) -> DataFrame:
    """(by, history, next) -> n. Sequences run per `keys`; counts pool over them unless listed in `by`."""
    return (_steps(df, order, keys, seq, state, split).groupBy(*by, "history", F.col(state).alias("next"))
            .agg(F.count(F.lit(1)).alias("n")))


def transition_matrix(counts: DataFrame, by=(), prior: float = 0.0, n_states: int = 0, fill_absorbing: DataFrame | None = None) -> DataFrame:
    """Row-normalized probabilities; `prior` adds Dirichlet mass per state. States in `fill_absorbing`
    that never leave get p(i,i)=1."""
    tot = counts.groupBy(*by, "history").agg(F.sum("n").alias("_t"))
    out = counts.join(tot, [*by, "history"]).withColumn("p", (F.col("n") + prior) / (F.col("_t") + prior * n_states)).drop("_t")
    if fill_absorbing is None:
        return out
    lone = fill_absorbing.select(*by, F.array("state").alias("history"), F.col("state").alias("next")).join(tot, [*by, "history"], "left_anti")
    return out.unionByName(lone.withColumns({"n": F.lit(0).cast("long"), "p": F.lit(1.0)}))


def interval_estimates(counts: DataFrame, n_states: int, prior: float = 1.0, z: float = 1.959963984540054) -> DataFrame:
    """Dirichlet posterior mean and a normal-approximation interval per transition."""
    m = transition_matrix(counts, prior=prior, n_states=n_states)
    tot = counts.groupBy("history").agg((F.sum("n") + prior * n_states).alias("_a"))
    sd = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("_a") + 1))
    return m.join(tot, "history").select("history", "next", "n", "p", F.greatest(F.lit(0.0), F.col("p") - z * sd).alias("low"),
                                         F.least(F.lit(1.0), F.col("p") + z * sd).alias("high"))


def order_selection(df: DataFrame, max_order: int, n_states: int, keys=("entity",), seq=("ts",), state="state", split=None) -> DataFrame:
    """Log-likelihood and BIC per order. The sum of log p over rows equals Σ n log p over the counted
    transitions, so the sequence is not joined back to its matrix."""
    out = None
    for k in range(1, max_order + 1):
        m = transition_matrix(transition_counts(df, k, keys, seq, state, split=split))
        row = m.agg(F.sum(F.col("n") * F.log("p")).alias("log_likelihood"), F.sum("n").alias("n_obs")).select(
            F.lit(k).alias("order"), "log_likelihood", "n_obs",
            (-2 * F.col("log_likelihood") + F.log("n_obs") * float(n_states ** (k + 1))).alias("bic"))
        out = row if out is None else out.unionByName(row)
    return out


def intensity(df: DataFrame, keys=("entity",), seq=("ts",), state="state", by=(), unit: float = 3600.0, split=None) -> DataFrame:
    """q_ij = transitions i->j / time spent in i (in `unit` seconds); the diagonal is minus the row sum."""
    x = over_rows(df, keys, list(seq), 0, lambda w: {"_to": F.lead(state).over(w), "_until": F.lead(seq[0]).over(w)}, ahead=1, split=split)
    x = x.where("_to is not null").withColumn("_dt", (F.unix_micros("_until") - F.unix_micros(seq[0])) / (1e6 * unit))
    held = x.groupBy(*by, F.col(state).alias("i")).agg(F.sum("_dt").alias("_h"), F.count_if(F.col("_to") != F.col(state)).alias("_out"))
    moves = x.where(F.col("_to") != F.col(state)).groupBy(*by, F.col(state).alias("i"), F.col("_to").alias("j")).agg(F.count(F.lit(1)).alias("_n"))
    off = moves.join(held, [*by, "i"]).where("_h > 0").select(*by, "i", "j", (F.col("_n") / F.col("_h")).alias("q"))
    diag = held.where("_h > 0").select(*by, "i", F.col("i").alias("j"), (-F.col("_out") / F.col("_h")).alias("q"))
    return off.unionByName(diag)


def intensity_moments(counts: DataFrame, dt: float) -> DataFrame:
    m = transition_matrix(counts).select(F.col("history")[0].alias("i"), F.col("next").alias("j"), "p")
    return m.select("i", "j", ((F.col("p") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)) / dt).alias("q"))


def holding_times(q: DataFrame, by=()) -> DataFrame:
    return q.where("i = j").select(*by, F.col("i").alias("state"), (-F.col("q")).alias("exit_rate"), F.try_divide(F.lit(-1.0), F.col("q")).alias("expected_holding"))


def step_distribution(start: DataFrame, matrix: DataFrame, steps: int) -> DataFrame:
    """start(key..., state, p) pushed through `steps` one-step joins; matrix(history, next, p)."""
    m = matrix.select(F.col("history")[0].alias("state"), F.col("next"), F.col("p").alias("_p"))
    keys = [c for c in start.columns if c not in ("state", "p")]
    out = start
    for _ in range(steps):
        out = out.join(m, "state").groupBy(*keys, F.col("next").alias("state")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))
    return out


def forecast(start: DataFrame, matrix: DataFrame, steps: int) -> DataFrame:
    """State distribution after `steps` steps of an order-k chain: (keys of start, state, p).

    start(key..., history, p) holds the last k states, matrix(history, next, p) an order-k chain. The k-grams are the
    nodes of a sparse graph, each with an edge to the gram that drops its first state and takes the next one, so a step
    is one sparse product and a key has at most as many rows as the chain has grams. A history of which no successor is
    known ends there: its mass stands under the null state, and p sums to 1 per key.
    """
    keys = [c for c in start.columns if c not in ("history", "p")]
    edge = matrix.select(F.col("history"), F.concat(F.slice("history", 2, F.size("history") - 1), F.array("next")).alias("_to"), F.col("p").alias("_p"))
    out = start.select(*keys, "history", "p")
    for _ in range(steps):
        out = (out.join(edge, "history", "left").groupBy(*keys, F.col("_to").alias("history"))
               .agg(F.sum(F.col("p") * F.coalesce("_p", F.lit(1.0))).alias("p")))  # the null history meets no edge and keeps its mass
    return out.groupBy(*keys, F.element_at("history", -1).alias("state")).agg(F.sum("p").alias("p"))


def last_states(df: DataFrame, k: int, keys=("entity",), seq=("ts",), state="state") -> DataFrame:
    """(keys, history, p = 1): the last k states of each key, oldest first; keys with fewer are left out. One map-side
    combined pass a step back, never a key's whole sequence in one task."""
    order, rest, found = F.struct(*seq), df.select(*keys, *seq, state), []
    for j in range(k):
        top = rest.groupBy(*keys).agg(F.max(F.struct(*seq, F.col(state).alias("_s"))).alias(f"_t{j}"))
        found.append(top)
        if j + 1 < k:
            rest = rest.join(top, list(keys)).where(order < F.struct(*[F.col(f"_t{j}.{c}") for c in seq])).select(*keys, *seq, state)
    out = found[0]
    for t in found[1:]:
        out = out.join(t, list(keys))
    return out.select(*keys, F.array(*[F.col(f"_t{j}._s") for j in reversed(range(k))]).alias("history"), F.lit(1.0).alias("p"))


def stationary(matrix: DataFrame, by: list[str], tol: float = 1e-13, max_iter: int = 20000, rates: bool = False) -> DataFrame:
    """Stationary distribution per key. A group is one chain's matrix (states squared, not data rows).
    Rates are turned into I + Q/λ first."""
    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema.fields}
    cols = ("i", "j", "q") if rates else ("history", "next", "p")
    m = matrix if rates else matrix.withColumn("history", F.col("history")[0])
    kind = kinds["i"] if rates else kinds["next"]

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(f[cols[0]]) | set(f[cols[1]]))
        at = {s: k for k, s in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        a[f[cols[0]].map(at), f[cols[1]].map(at)] = f[cols[2]]
        if rates:
            lam = max(np.abs(np.diag(a)).max(), 1e-300) * 1.05
            a = np.eye(len(names)) + a / lam
        v = np.full(len(names), 1 / len(names))
        for _ in range(max_iter):
            w = v @ (a + np.eye(len(names))) / 2
            w /= w.sum()
            if np.abs(w - v).max() < tol:
                break
            v = w
        out = pd.DataFrame({"state": names, "pi": w})
        for b in by:
            out[b] = f[b].iloc[0]
        return out[[*by, "state", "pi"]]

    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + [f"state {kind}", "pi double"])
    return m.groupBy(*by).applyInPandas(solve, schema)


def state_correlation(df: DataFrame, cols: list[str], keys=("symbol",)) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return df.groupBy(*keys, "state").agg(*[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs], F.count(F.lit(1)).alias("n"))
