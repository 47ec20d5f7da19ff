"""Value at risk, expected shortfall, drawdown and ratios per key."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.mathx import z_value
from tidemark.operators.indicators import drawdown, worst_drawdown
from tidemark.plans.ordered import over_rows, quantiles, running

LEVELS = (0.95, 0.99, 0.999)
DAYS = 252


def tag(level: float) -> str:
    """0.95 -> 95, 0.999 -> 999: one distinct name per level."""
    return f"{level:.6f}".split(".")[1].rstrip("0")


def _std(c, ddof: int) -> Column:
    return F.stddev_samp(c) if ddof else F.stddev_pop(c)


def historical_var(df: DataFrame, ret="ret", keys=("symbol",), levels=LEVELS, split=False) -> DataFrame:
    return quantiles(df, list(keys), ret, {f"var_{tag(c)}": round(1 - c, 12) for c in levels}, split=split)


def parametric_var(df: DataFrame, ret="ret", keys=("symbol",), levels=LEVELS, ddof: int = 0) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.avg(ret) + z_value(1 - c) * _std(ret, ddof)).alias(f"var_{tag(c)}") for c in levels])


def cornish_fisher_var(df: DataFrame, ret="ret", keys=("symbol",), levels=LEVELS) -> DataFrame:
    s, k = F.skewness(ret), F.kurtosis(ret)
    out = []
    for c in levels:
        z = z_value(1 - c)
        zcf = z + (z ** 2 - 1) / 6 * s + (z ** 3 - 3 * z) / 24 * k - (2 * z ** 3 - 5 * z) / 36 * s * s
        out.append((F.avg(ret) + zcf * F.stddev_pop(ret)).alias(f"var_{tag(c)}"))
    return df.groupBy(*keys).agg(*out)


def expected_shortfall(df: DataFrame, ret="ret", keys=("symbol",), levels=LEVELS, split=False, var: DataFrame | None = None) -> DataFrame:
    """VaR and the mean of the returns at or below it (VaR itself when that tail is empty).

    Bounded keys (`split=False`) take the quantile as a window over the key, so input, quantile and
    tail mean share one shuffle; otherwise the quantiles are joined back.
    """
    cols = [f"var_{tag(c)}" for c in levels]
    if var is None and split is False:
        q = F.percentile(ret, [round(1 - c, 12) for c in levels]).over(Window.partitionBy(*keys))
        j = df.where(F.col(ret).isNotNull()).withColumn("_q", q).withColumns({v: F.col("_q")[i] for i, v in enumerate(cols)})
    else:
        j = df.join(historical_var(df, ret, keys, levels, split) if var is None else var, list(keys))
    return j.groupBy(*keys).agg(*[F.first(v).alias(v) for v in cols], *[
        F.coalesce(F.avg(F.when(F.col(ret) <= F.col(v), F.col(ret))), F.first(v)).alias(v.replace("var", "es")) for v in cols])


def wealth(df: DataFrame, ret="ret", keys=("symbol",), split=False) -> DataFrame:
    return running(df, keys, ["ts"], {"wealth": ("product", 1 + F.col(ret))}, split=split)


def max_drawdown_of_returns(df: DataFrame, ret="ret", keys=("symbol",), split=False) -> DataFrame:
    dd = drawdown(wealth(df, ret, keys, split), "wealth", keys, split)
    return dd.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def ratios(df: DataFrame, ret="ret", keys=("symbol",), rf: float = 0.02, annual: bool = True, split=False) -> DataFrame:
    """Sharpe, Sortino, Calmar, Omega, tail ratio.

    `annual=True`: annualized, sigma over n, Sortino sigma of the negative returns.
    `annual=False`: daily, sigma over n-1; Omega is infinite when nothing is lost.
    """
    ddof, unit = (0, DAYS) if annual else (1, 1)
    root = math.sqrt(unit)
    cut = rf / DAYS
    r = F.col(ret)
    down = F.when(r < 0, r)
    agg = df.groupBy(*keys).agg(
        F.avg(ret).alias("_m"), _std(ret, ddof).alias("_s"), _std(down, ddof).alias("_d"),
        F.sum(F.when(r > cut, r - cut)).alias("_gain"), F.sum(F.when(r < cut, cut - r)).alias("_loss"))
    q = quantiles(df, list(keys), ret, {"_p95": .95, "_p5": .05}, split=split)
    j = agg.join(q, list(keys)).join(max_drawdown_of_returns(df, ret, keys, split), list(keys))
    excess = F.col("_m") * unit - rf * unit / DAYS
    zero = F.lit(0.0)
    gain = F.coalesce("_gain", zero)
    omega = gain / F.coalesce("_loss", F.lit(1e-8)) if annual else \
        F.when(F.coalesce("_loss", zero) == 0, F.lit(float("inf"))).otherwise(gain / F.col("_loss"))
    tail = F.when(F.col("_p5") < 0, F.col("_p95") / F.abs("_p5")).otherwise(F.col("_p95")) if annual else \
        F.try_divide(F.abs("_p95"), F.abs("_p5"))
    return j.select(
        *keys, F.coalesce(F.try_divide(excess, F.col("_s") * root), zero).alias("sharpe"),
        F.coalesce(F.try_divide(excess, F.col("_d") * root), zero).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, F.col("_m") * DAYS / F.abs("max_drawdown")).otherwise(zero).alias("calmar"),
        omega.alias("omega"), tail.alias("tail_ratio"), "max_drawdown", F.col("_s").alias("volatility"))


def omega_ratio(df: DataFrame, threshold: float, ret="ret", keys=("symbol",)) -> DataFrame:
    e = F.col(ret) - threshold
    gain, loss = F.sum(F.when(e > 0, e).otherwise(0.0)), F.sum(F.when(e < 0, -e).otherwise(0.0))
    return df.groupBy(*keys).agg(F.when(loss == 0, F.lit(float("inf"))).otherwise(gain / loss).alias("omega"))


def risk_report(prices: DataFrame, rets: DataFrame, keys=("symbol",), rf: float = 0.02, split=False) -> DataFrame:
    """VaR/ES at 95, 99, 99.9%, worst drawdown of the price and the annual ratios, one row per key."""
    es = expected_shortfall(rets, keys=keys, split=split)
    dd = worst_drawdown(prices, keys=keys, split=split).select(*keys, F.col("max_drawdown").alias("price_drawdown"), "duration", "recovery")
    return es.join(dd, list(keys)).join(ratios(rets, keys=keys, rf=rf, split=split), list(keys))


def path_risk(paths: DataFrame, keys=("symbol",), path="path_id", order="step", price="price", split=False) -> DataFrame:
    """Risk of pooled path returns: VaR, ES, moments, worst drawdown over all paths, ratios."""
    by = [*keys, path]
    r = over_rows(paths, by, [order], 1, lambda w: {"ret": F.try_divide(F.col(price), F.lag(price).over(w)) - 1}, split=split)
    worst = running(paths, by, [order], {"_peak": ("max", F.col(price))}, split=split).groupBy(*keys).agg(
        F.min((F.col(price) - F.col("_peak")) / F.col("_peak")).alias("max_drawdown"))
    rets = r.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    m = rets.groupBy(*keys).agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("volatility"), F.skewness("ret").alias("skew"),
                                F.kurtosis("ret").alias("kurt"), F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).alias("_d"))
    j = expected_shortfall(rets, keys=keys).join(m, list(keys)).join(worst, list(keys))
    zero = F.lit(0.0)
    return j.withColumns({
        "sharpe": F.coalesce(F.try_divide(F.col("mean"), F.col("volatility")), zero),
        "sortino": F.coalesce(F.try_divide(F.col("mean"), F.coalesce("_d", "volatility")), zero),
        "calmar": F.when(F.col("max_drawdown") < 0, F.col("mean") / F.abs("max_drawdown")).otherwise(zero)}).drop("_d")


def var_report(df: DataFrame, ret="ret", keys=("symbol",), levels=(0.95, 0.99), split=False) -> DataFrame:
    """Historical and parametric VaR as rows with n, mean, sigma."""
    meta = df.groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("std"))
    parts = [historical_var(df, ret, keys, levels, split).withColumn("method", F.lit("historical")),
             parametric_var(df, ret, keys, levels).withColumn("method", F.lit("parametric"))]
    return parts[0].unionByName(parts[1]).join(meta, list(keys))


def var_coverage(rolling: DataFrame, rets: DataFrame, tolerance: float = 0.005, split=False) -> DataFrame:
    """Share of returns below the VaR forecast of the row before; inside when within the tolerance."""
    j = rets.join(rolling.select("symbol", "ts", "var_95", "var_99"), ["symbol", "ts"], "left")
    j = over_rows(j, ("symbol",), ["ts"], 1, lambda w: {"f95": F.lag("var_95").over(w), "f99": F.lag("var_99").over(w)}, split=split)
    out = j.where("f95 is not null").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") < F.col("f95")).cast("double")).alias("hit_95"),
        F.avg((F.col("ret") < F.col("f99")).cast("double")).alias("hit_99"))
    return out.withColumns({"ok_95": F.abs(F.col("hit_95") - 0.05) <= tolerance, "ok_99": F.abs(F.col("hit_99") - 0.01) <= tolerance})


def performance(df: DataFrame, bench: DataFrame | None = None, ret="ret", keys=("symbol",), rf: float = 0.02, split=False) -> DataFrame:
    """Total and annualized return, volatility, Sharpe, drawdown, Calmar, moments; with a benchmark
    also beta, alpha, information ratio and tracking error."""
    from tidemark.operators.aggregate import kurt_unbiased, skew_unbiased
    n = F.count(ret)
    total = F.product(1 + F.col(ret)) - 1
    out = df.groupBy(*keys).agg(
        total.alias("total_return"), (F.pow(1 + total, DAYS / n) - 1).alias("annualized_return"),
        (F.stddev_samp(ret) * math.sqrt(DAYS)).alias("annualized_volatility"),
        (F.try_divide(F.avg(ret) - rf / DAYS, F.stddev_samp(ret)) * math.sqrt(DAYS)).alias("sharpe"),
        skew_unbiased(ret).alias("skew"), kurt_unbiased(ret).alias("kurt"), F.max(ret).alias("best"), F.min(ret).alias("worst"))
    out = out.join(max_drawdown_of_returns(df, ret, keys, split), list(keys))
    out = out.withColumn("calmar", F.coalesce(F.try_divide(F.col("annualized_return"), F.abs("max_drawdown")), F.lit(0.0)))
    return out if bench is None else out.join(relative(df, bench, ret, keys, rf), list(keys))


def relative(df: DataFrame, bench: DataFrame, ret="ret", keys=("symbol",), rf: float = 0.02) -> DataFrame:
    j = df.join(bench, "ts")
    act = F.col(ret) - F.col("bench_ret")
    beta = F.coalesce(F.try_divide(F.covar_samp(ret, "bench_ret"), F.var_samp("bench_ret")), F.lit(0.0))
    te = F.stddev_samp(act)
    alpha = (F.avg(ret) - rf / DAYS - beta * (F.avg("bench_ret") - rf / DAYS)) * DAYS
    return j.groupBy(*keys).agg(beta.alias("beta"), alpha.alias("alpha"), (te * math.sqrt(DAYS)).alias("tracking_error"),
                                F.coalesce(F.try_divide(F.avg(act), te) * math.sqrt(DAYS), F.lit(0.0)).alias("information_ratio"))
