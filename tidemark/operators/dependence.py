"""Dependence between pairs of series: normal scores, rank correlation, tails, family selection."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.mathx import norm_ppf
from tidemark.operators.indicators import pair_returns, rank_transform

P = ["sym_i", "sym_j"]


def uniforms(rets: DataFrame, split=False) -> DataFrame:
    return rank_transform(rets, "ret", split=split).select("symbol", "ts", "u")


def pairs_of_uniforms(rets: DataFrame, split=False) -> DataFrame:
    """(sym_i, sym_j, ts, u, v): ranks within each series over its own rows."""
    p = pair_returns(uniforms(rets, split).withColumnRenamed("u", "ret"))
    return p.withColumnsRenamed({"ri": "u", "rj": "v"})


def normal_score_correlation(rets: DataFrame, split=False) -> DataFrame:
    p = pairs_of_uniforms(rets, split).withColumns({"a": norm_ppf("u"), "b": norm_ppf("v")})
    return p.groupBy(*P).agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"))


def _inversions(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted copy and number of pairs out of order, by merging halves."""
    if len(y) <= 64:
        return np.sort(y), int((y[:, None] > y[None, :])[np.triu_indices(len(y), 1)].sum())
    h = len(y) // 2
    a, na = _inversions(y[:h])
    b, nb = _inversions(y[h:])
    return np.sort(np.concatenate([a, b]), kind="stable"), na + nb + int((len(a) - np.searchsorted(a, b, "right")).sum())


def _ties(x: np.ndarray) -> int:
    c = np.unique(x, return_counts=True)[1].astype(np.int64)
    return int((c * (c - 1) // 2).sum())


def kendall(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Kendall tau-b per pair in n log n. A pair's rows are two bar series, bounded by the calendar."""
    def tau(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([u, v])
        x, y = f[u].to_numpy(), f[v].to_numpy()
        n0 = len(x) * (len(x) - 1) // 2
        n1, n2, n3 = _ties(x), _ties(y), int((lambda c: (c * (c - 1) // 2).sum())(f.groupby([u, v]).size().to_numpy()))
        dis = _inversions(y)[1]
        den = math.sqrt((n0 - n1) * (n0 - n2))
        t = (n0 - n1 - n2 + n3 - 2 * dis) / den if den else float("nan")
        return pd.DataFrame({"sym_i": [f["sym_i"].iloc[0]], "sym_j": [f["sym_j"].iloc[0]], "tau": [t], "n": [len(x)]})

    return pairs.select(*P, u, v).groupBy(*P).applyInPandas(tau, "sym_i string, sym_j string, tau double, n long")


def copula_parameters(tau: DataFrame) -> DataFrame:
    """Clayton 2τ/(1-τ) (0.1 when τ <= 0, at least 0.01); Gumbel 1/(1-τ) (1.1 when τ <= 0, at least 1.01)."""
    t = F.col("tau")
    return tau.withColumns({"clayton": F.greatest(F.when(t > 0, 2 * t / (1 - t)).otherwise(0.1), F.lit(0.01)),
                            "gumbel": F.greatest(F.when(t > 0, 1 / (1 - t)).otherwise(1.1), F.lit(1.01))})


def tail_dependence(pairs: DataFrame) -> DataFrame:
    """Mean over ten thresholds of P(v beyond t | u beyond t), upper and lower."""
    ups, downs = [0.9 + 0.01 * i for i in range(10)], [0.01 + 0.01 * i for i in range(10)]
    def share(hit, base):
        return F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0))
    cols = [share(F.col("v") > t, F.col("u") > t).alias(f"_u{i}") for i, t in enumerate(ups)]
    cols += [share(F.col("v") <= t, F.col("u") <= t).alias(f"_d{i}") for i, t in enumerate(downs)]
    g = pairs.groupBy(*P).agg(*cols)
    def mean(tag):
        xs = F.array_compact(F.array(*[F.col(f"_{tag}{i}") for i in range(10)]))
        return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, b: a + b) / F.size(xs)).otherwise(0.0)
    return g.select(*P, mean("u").alias("upper"), mean("d").alias("lower"))


def family_selection(rets: DataFrame, split=False) -> DataFrame:
    """Log-likelihood, AIC, BIC of Gaussian, Clayton and Gumbel per pair; `best` marks the lowest AIC."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    p = pairs_of_uniforms(rets, split)
    par = copula_parameters(kendall(p)).join(normal_score_correlation(rets, split).select(*P, "rho"), P)
    x = p.withColumns({"u": clip("u"), "v": clip("v")}).withColumns({"a": norm_ppf("u"), "b": norm_ppf("v")}).join(par, P)
    r, a, b = F.col("rho"), F.col("a"), F.col("b")
    det = 1 - r * r
    gauss = -0.5 * (F.log(det) + (r * r * (a * a + b * b) - 2 * r * a * b) / det)
    th, lu, lv = F.col("clayton"), F.log("u"), F.log("v")
    clay = F.log(1 + th) - (1 + th) * (lu + lv) - (2 + 1 / th) * F.log(F.pow("u", -th) + F.pow("v", -th) - 1)
    g, x1, x2 = F.col("gumbel"), -lu, -lv
    big = F.pow(x1, g) + F.pow(x2, g)
    root = F.pow(big, 1 / g)
    gum = -root + (g - 1) * (F.log(x1) + F.log(x2)) + (1 / g - 2) * F.log(big) + F.log(root + g - 1) - lu - lv
    s = x.groupBy(*P).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in (("gaussian", gauss), ("clayton_ll", clay), ("gumbel_ll", gum))])
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.col(c).alias("log_likelihood")) for n, c in
                     (("gaussian", "gaussian"), ("clayton", "clayton_ll"), ("gumbel", "gumbel_ll"))])
    t = s.select(*P, "n", F.explode(rows).alias("e")).select(*P, "n", "e.*")
    t = t.withColumns({"aic": 2 - 2 * F.col("log_likelihood"), "bic": F.log("n") - 2 * F.col("log_likelihood")})
    best = t.groupBy(*P).agg(F.min_by("family", "aic").alias("_best"))
    return t.join(best, P).withColumn("best", F.col("family") == F.col("_best")).drop("_best")
