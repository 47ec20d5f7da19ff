"""Statistical tests, chain diagnostics and model checks, one result row per key."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.mathx import chi2_sf, chi2_sf_even, norm_cdf, t_two_sided, z_value
from tidemark.functions.scalar import equal_width_bin
from tidemark.operators.aggregate import contingency
from tidemark.operators.indicators import autocorrelation
from tidemark.operators.regression import ols
from tidemark.plans.ordered import over_rows, row_index, running

K = ("symbol",)
# Fixed value: 5% point of A² for a normal with estimated mean and variance (Stephens).
ANDERSON_5 = 0.787


def jarque_bera(df: DataFrame, col: str = "ret", keys=K) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(col).alias("n"), F.skewness(col).alias("_s"), F.kurtosis(col).alias("_k"))
    jb = F.col("n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    return out.select(*keys, "n", jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def _ranked(df, col, keys, ddof, split):
    sd = F.stddev_samp(col) if ddof else F.stddev_pop(col)
    m = df.groupBy(*keys).agg(F.avg(col).alias("_m"), sd.alias("_s"), F.count(col).alias("_n"))
    r = row_index(df.where(F.col(col).isNotNull()), keys, [col], split=split).join(m, list(keys))
    return r.withColumn("_x", (F.col(col) - F.col("_m")) / F.col("_s")).withColumn("_f", norm_cdf("_x")).withColumn("_i", F.col("_rn") + 1)


def ks_normal(df: DataFrame, col: str = "ret", keys=K, split=False) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal of the standardized values, asymptotic p."""
    r = _ranked(df, col, keys, 0, split)
    d = F.greatest(F.col("_i") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("_n"))
    out = r.groupBy(*keys).agg(F.max(d).alias("statistic"), F.max("_n").alias("n"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("statistic")
    p = sum((2 * (-1) ** (k - 1)) * F.exp(-2 * k * k * lam * lam) for k in range(1, 6))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def anderson_darling(df: DataFrame, col: str = "ret", keys=K, split=False) -> DataFrame:
    """A² against the normal with both moments estimated, its 5% critical value for n rows and the verdict. Pairing F_i with F_{n+1-i} is moved into the weight of 1-F_i, so each
    row needs only its own rank."""
    r = _ranked(df, col, keys, 1, split)
    i, n, f = F.col("_i"), F.col("_n"), F.col("_f")
    term = (2 * i - 1) * F.log(f) + (2 * (n + 1 - i) - 1) * F.log(1 - f)
    out = r.groupBy(*keys).agg(F.sum(term).alias("_t"), F.max("_n").alias("n"))
    out = out.select(*keys, "n", (-F.col("n") - F.col("_t") / F.col("n")).alias("statistic"))
    crit = F.round(ANDERSON_5 / (1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n"))), 3)
    return out.withColumns({"critical_5": crit, "normal": F.col("statistic") < crit})


def ljung_box(df: DataFrame, lags: int = 20, col: str = "ret", keys=K, split=False) -> DataFrame:
    m = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.count(col).alias("_n"), F.var_pop(col).alias("_v"))
    x = df.join(m, list(keys)).withColumn("_d", F.col(col) - F.col("_m"))
    x = over_rows(x, keys, ["ts"], lags, lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}, split=split)
    agg = x.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_v").alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    rho2 = sum(F.pow(F.col(f"_c{k}") / (F.col("n") * F.col("_v")), 2) / (F.col("n") - k) for k in range(1, lags + 1))
    q = F.col("n") * (F.col("n") + 2) * rho2
    p = chi2_sf_even(F.col("statistic"), lags) if lags % 2 == 0 else chi2_sf(F.col("statistic"), F.lit(float(lags)))
    return agg.select(*keys, "n", q.alias("statistic")).withColumn("p_value", p)


def dickey_fuller(df: DataFrame, lags: int = 1, col: str = "ret", keys=K, split=False) -> DataFrame:
    """t statistic of the level in dy = a + b y[-1] + Σ c dy[-i]; 5% critical value of the constant case."""
    x = over_rows(df, keys, ["ts"], lags + 1, lambda w: {
        "_y1": F.lag(col).over(w), "_dy": F.col(col) - F.lag(col).over(w),
        **{f"_d{i}": F.lag(col, i).over(w) - F.lag(col, i + 1).over(w) for i in range(1, lags + 1)}}, split=split)
    fit = ols(x, list(keys), "_dy", ["_y1"] + [f"_d{i}" for i in range(1, lags + 1)])
    t = F.col("coef")[1] / F.col("se")[1]
    return fit.select(*keys, F.col("n").cast("long").alias("n"), t.alias("statistic"), F.lit(-2.86).alias("critical_5"), (t < -2.86).alias("stationary"))


def kpss(df: DataFrame, lags: int = 10, col: str = "ret", keys=K, split=False) -> DataFrame:
    """Level KPSS: Σ S_t² / (n² s²) with Bartlett weights over `lags` lags."""
    m = df.groupBy(*keys).agg(F.avg(col).alias("_m"))
    x = df.join(m, list(keys)).withColumn("_e", F.col(col) - F.col("_m"))
    x = over_rows(x, keys, ["ts"], lags, lambda w: {f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)}, split=split)
    x = running(x, keys, ["ts"], {"_s": ("sum", F.col("_e"))}, split=split)
    n = F.count(F.lit(1))
    lrv = F.sum(F.col("_e") * F.col("_e")) + 2 * sum((1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags + 1))
    stat = F.sum(F.col("_s") * F.col("_s")) / (n * lrv)
    return x.groupBy(*keys).agg(n.alias("n"), stat.alias("statistic"), F.lit(0.463).alias("critical_5"), (stat < 0.463).alias("stationary"))


def heteroscedasticity(df: DataFrame, resid: str, fitted: str, kind: str = "breusch_pagan", keys=K) -> DataFrame:
    """LM = n R² of squared residuals on the fitted values (White adds their squares)."""
    x = df.withColumns({"_e2": F.col(resid) * F.col(resid), "_f2": F.col(fitted) * F.col(fitted)})
    xs = [fitted] if kind == "breusch_pagan" else [fitted, "_f2"]
    fit = ols(x, list(keys), "_e2", xs)
    lm = F.col("n") * F.col("r2")
    crit = {1: 3.841458820694124, 2: 5.991464547107979}[len(xs)]
    return fit.select(*keys, F.col("n").cast("long").alias("n"), lm.alias("statistic"), F.lit(crit).alias("critical_5"), (lm > crit).alias("significant"))


def independence(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """χ² of the binned contingency table."""
    t = contingency(df, x, y, bins).where("bx is not null and by is not null")
    rows, cols = t.groupBy("bx").agg(F.sum("n").alias("r")), t.groupBy("by").agg(F.sum("n").alias("c"))
    tot = t.agg(F.sum("n").alias("t"))
    # every pair of bins is a cell, filled or not; in doubles, since products of counts leave 64 bits
    j = rows.join(F.broadcast(cols)).join(F.broadcast(tot)).join(t, ["bx", "by"], "left")
    e = F.col("r").cast("double") * F.col("c") / F.col("t")
    gap = F.coalesce("n", F.lit(0)) - e
    size = rows.agg((F.count(F.lit(1)) - 1).alias("_a")).join(F.broadcast(cols.agg((F.count(F.lit(1)) - 1).alias("_b"))))
    out = j.agg(F.sum(gap * gap / e).alias("statistic")).join(F.broadcast(size))
    return out.select("statistic", (F.col("_a") * F.col("_b")).alias("df")).withColumn("p_value", chi2_sf(F.col("statistic"), F.col("df").cast("double")))


def ramsey_reset(df: DataFrame, actual: str, predicted: str, keys=K) -> DataFrame:
    p = F.col(predicted)
    x = df.withColumns({"_r": F.col(actual) - p, "_p1": p, "_p2": p * p, "_p3": p * p * p})
    fit = ols(x, list(keys), "_r", ["_p1", "_p2", "_p3"])
    f = (F.col("r2") / 3) / ((1 - F.col("r2")) / (F.col("n") - 4))
    return fit.select(*keys, F.col("n").cast("long").alias("n"), F.col("r2"), f.alias("statistic"))


def moment_tests(df: DataFrame, col: str, mean: float, variance: float, keys=K) -> DataFrame:
    n = F.count(col)
    t = (F.avg(col) - mean) / (F.stddev_pop(col) / F.sqrt(n))
    chi = (n - 1) * F.var_pop(col) / variance
    out = df.groupBy(*keys).agg(n.alias("n"), t.alias("t_statistic"), chi.alias("chi2_statistic"))
    p = chi2_sf(F.col("chi2_statistic"), (F.col("n") - 1).cast("double"))
    return out.withColumns({"t_p_value": t_two_sided(F.abs("t_statistic"), (F.col("n") - 1).cast("double")), "chi2_p_value": 2 * F.least(p, 1 - p)})


def markov_fit(counts: DataFrame, theory: DataFrame) -> DataFrame:
    """χ² of observed transitions against p(history, next)."""
    tot = counts.groupBy("history").agg(F.sum("n").alias("_t"))
    e = theory.select("history", "next", "p").join(tot, "history").withColumn("_e", F.greatest(F.col("_t") * F.col("p"), F.lit(1e-8)))
    j = e.join(counts, ["history", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    k = theory.select("next").distinct().agg(F.count(F.lit(1)).alias("_k"))
    out = j.agg(F.sum((F.col("n") - F.col("_e")) * (F.col("n") - F.col("_e")) / F.col("_e")).alias("statistic")).join(F.broadcast(k))
    return out.select("statistic", (F.col("_k") * (F.col("_k") - 1)).alias("df")).withColumn("p_value", chi2_sf(F.col("statistic"), F.col("df").cast("double")))


def markov_property(second: DataFrame, first: DataFrame, min_hits: int = 5) -> DataFrame:
    """Share of (a, b, c) cells with more than `min_hits` hits that leave n_ab·p_bc ± 2√e."""
    pair = second.groupBy("history").agg(F.sum("n").alias("_ab"))
    p = first.select(F.col("history")[0].alias("_b"), "next", "p")
    j = second.where(F.col("n") > min_hits).join(pair, "history").withColumn("_b", F.element_at("history", -1)).join(p, ["_b", "next"])
    e = F.col("_ab") * F.col("p")
    bad = F.abs(F.col("n") - e) > 2 * F.sqrt(e)
    return j.agg(F.count(F.lit(1)).alias("tests"), F.count_if(bad).alias("violations"), F.avg(bad.cast("double")).alias("violation_rate"))


def batch_convergence(df: DataFrame, col: str, batch: Column, keys=K, tolerance: float = 0.01, z: float | None = None) -> DataFrame:
    """Cumulative mean, standard error, interval and relative change over the last 5 batches."""
    z = z or z_value(0.975)
    b = df.groupBy(*keys, batch.alias("batch")).agg(F.count(col).alias("_n"), F.sum(col).alias("_s"), F.sum(F.col(col) * F.col(col)).alias("_q"))
    b = running(b, keys, ["batch"], {c: ("sum", F.col(f"_{c}")) for c in ("n", "s", "q")}, split=None)
    est = F.col("s") / F.col("n")
    b = b.withColumns({"estimate": est, "standard_error": F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n"))})
    b = over_rows(b, keys, ["batch"], 4, lambda w: {"_five": F.lag("estimate", 4).over(w)}, split=None)
    change = F.abs(F.col("estimate") - F.col("_five")) / F.abs(F.col("_five") + 1e-8)
    ok = (change < tolerance) & (F.col("standard_error") / F.abs(F.col("estimate") + 1e-8) < tolerance)
    return b.select(*keys, "batch", "n", "estimate", "standard_error", (F.col("estimate") - z * F.col("standard_error")).alias("low"),
                    (F.col("estimate") + z * F.col("standard_error")).alias("high"), change.alias("relative_change"), F.coalesce(ok, F.lit(False)).alias("converged"))


def convergence_rate(batches: DataFrame, keys=K, last: int = 10) -> DataFrame:
    """Minus the slope of ln(standard error) on ln(n) over the last batches."""
    top = batches.groupBy(*keys).agg(F.max("batch").alias("_b"))
    x = batches.join(top, list(keys)).where(F.col("batch") > F.col("_b") - last)
    return x.groupBy(*keys).agg((-F.regr_slope(F.log("standard_error"), F.log("n"))).alias("rate"))


def block_divergence(df: DataFrame, pi: DataFrame, block: Column, state: str = "state", size: int = 500) -> DataFrame:
    """KL and total variation of each full block of states against `pi(state, pi)`."""
    c = df.groupBy(block.alias("block"), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    full = c.groupBy("block").agg(F.sum("n").alias("_t")).where(F.col("_t") == size).select("block")
    names = pi.agg(F.collect_list(F.struct("state", "pi")).alias("_pi"))  # one row, one entry per state
    grid = full.join(F.broadcast(names)).select("block", F.explode("_pi").alias("e")).select("block", "e.state", "e.pi")
    e = F.coalesce(F.col("n"), F.lit(0)) / size
    j = grid.join(c, ["block", "state"], "left")
    return j.groupBy("block").agg(F.sum(e * F.log((e + 1e-8) / (F.col("pi") + 1e-8))).alias("kl"), (0.5 * F.sum(F.abs(e - F.col("pi")))).alias("tv"))


def option_checks(quotes: DataFrame, spot: float, rate: float, years: float, tol: float = 1e-6, key: str = "book") -> DataFrame:
    """Lower bound, put-call parity, convexity (and the concavity flag) per strike: quotes(key, strike, call, put)."""
    disc = math.exp(-rate * years)
    w = Window.partitionBy(key).orderBy("strike")  # one row per quoted strike
    k, c = F.col("strike"), F.col("call")
    bound = F.greatest(F.lit(0.0), spot - k * disc)
    left = (c - F.lag("call").over(w)) / (k - F.lag("strike").over(w))
    right = (F.lead("call").over(w) - c) / (F.lead("strike").over(w) - k)
    parity = F.abs(c - F.col("put") - (spot - k * disc))
    return quotes.select(key, "strike", (c >= bound - tol).alias("bound_ok"), F.greatest(bound - c, F.lit(0.0)).alias("bound_gap"),
                         (parity <= tol).alias("parity_ok"), parity.alias("parity_gap"), F.coalesce(right >= left - tol, F.lit(True)).alias("convex_ok"),
                         F.coalesce(right <= left + tol, F.lit(True)).alias("concave_flag"))


def relation_checks(metrics: DataFrame, rules: list[tuple[str, str, str, float]], keys: list[str]) -> DataFrame:
    """Rules (name, kind, expression, tolerance) over metric columns. Kinds: equality (expression is
    zero), inequality (expression is true), range (expression is in [0, tolerance])."""
    rows = []
    for name, kind, text, tol in rules:
        v = F.expr(text)
        if kind == "inequality":
            ok, gap = v, F.when(v, 0.0).otherwise(1.0)
        else:
            d = v.cast("double")
            ok = F.abs(d) <= tol if kind == "equality" else (d >= 0) & (d <= tol)
            gap = F.abs(d) if kind == "equality" else F.greatest(-d, d - tol, F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("rule"), ok.alias("consistent"), gap.alias("discrepancy")))
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("e")).select(*keys, "e.*")


def chain_diagnostics(df: DataFrame, col: str = "ret", keys=K, max_lag: int = 99, split=False) -> DataFrame:
    """Geweke z, effective sample size, autocorrelation time, running-mean stability per chain."""
    x = row_index(df, keys, ["ts"], split=split)
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x = x.join(n, list(keys))
    head, tail = F.col("_rn") < F.floor(0.1 * F.col("n")), F.col("_rn") >= F.col("n") - F.floor(0.5 * F.col("n"))
    def part(c):
        v = F.when(c, F.col(col))
        return F.avg(v), F.var_pop(v) / F.count(v)
    (ma, va), (mb, vb) = part(head), part(tail)
    gew = x.groupBy(*keys).agg(((ma - mb) / F.sqrt(va + vb)).alias("geweke"), F.max("n").alias("n"))
    rho = autocorrelation(df, list(range(1, max_lag + 1)), col, keys, split).join(n, list(keys))
    def first_stop(limit):
        return F.coalesce(F.min(F.when(F.coalesce(F.col("rho"), F.lit(0.0)) <= 0, F.col("lag"))), limit)
    ess_lim, act_lim = F.least(F.floor(F.col("n") / 4), F.lit(100)), F.least(F.floor(F.col("n") / 10), F.lit(50))
    stops = rho.groupBy(*keys).agg(first_stop(F.lit(max_lag + 1)).alias("_stop"))
    r = rho.join(stops, list(keys))
    inside = (F.col("lag") < F.col("_stop")) & (F.col("lag") < ess_lim)
    early = (F.col("lag") < F.col("_stop")) & (F.col("lag") < act_lim)
    out = r.groupBy(*keys).agg(
        F.greatest(F.lit(1.0), F.first("n") / (2 * (1 + 2 * F.sum(F.when(inside, F.col("rho")).otherwise(0.0))))).alias("effective_size"),
        F.coalesce(F.min(F.when(early & (F.col("rho") < 1 / math.e), F.col("lag"))), F.max(F.when(early, F.col("lag"))), F.lit(1)).cast("double").alias("autocorrelation_time"))
    win = F.greatest(F.lit(50), F.floor(F.col("n") / 20))
    cum = running(x, keys, ["ts"], {"_cs": ("sum", F.col(col))}, split=split)
    pts = cum.where((F.col("_rn") + 1 >= win) & (F.col("_rn") + 1 < F.col("n")) & ((F.col("_rn") + 1 - win) % F.floor(win / 2) == 0))
    lastw = Window.partitionBy(*keys).orderBy(F.desc("_rn"))  # at most 40 checkpoints per chain
    pts = pts.withColumn("_k", F.row_number().over(lastw)).where("_k <= 3").withColumn("_mean", F.col("_cs") / (F.col("_rn") + 1))
    stab = pts.groupBy(*keys).agg((F.stddev_pop("_mean") / (F.abs(F.avg("_mean")) + 1e-8) < 0.01).alias("_ok"), F.count(F.lit(1)).alias("_c"))
    return gew.join(out, list(keys)).join(stab, list(keys), "left").withColumn(
        "running_mean_stable", F.coalesce(F.when(F.col("_c") < 3, True).otherwise(F.col("_ok")), F.lit(True))).drop("_ok", "_c")
