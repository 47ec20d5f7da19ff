"""Calibration tables of the crypto models."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.aggregate import correlation
from tidemark.operators.align import align_from_end
from tidemark.operators.indicators import log_return, rolling
from tidemark.plans.ordered import over_rows, quantiles


def jump_statistics(rets: DataFrame, keys=("symbol",), k: float = 3.0) -> DataFrame:
    base = rets.groupBy(*keys).agg((F.avg("ret") * 252).alias("drift"), (F.stddev_pop("ret") * math.sqrt(252)).alias("base_vol"),
                                   F.stddev_pop("ret").alias("_s"), F.count("ret").alias("_n"))
    j = rets.join(base, list(keys))
    jump = F.when(F.abs("ret") > k * F.col("_s"), F.col("ret"))
    return j.groupBy(*keys).agg(F.first("drift").alias("drift"), F.first("base_vol").alias("base_vol"),
                                (F.count(jump) / (F.first("_n") / 252)).alias("jump_intensity"), F.avg(jump).alias("jump_mean"), F.stddev_pop(jump).alias("jump_std"))


def volatility_regimes(rets: DataFrame, n: int = 20, split=False) -> DataFrame:
    """Regime 0/1/2 by the 33/66% quantiles of the rolling volatility; drift and row count per regime."""
    v = rolling(rets, n, "ret", {"vol": F.stddev_samp("ret")}, split=split).where("vol is not null")
    v = v.withColumn("vol", F.col("vol") * math.sqrt(252))
    j = v.join(quantiles(v, ["symbol"], "vol", {"_a": .33, "_b": .66}, split=split), "symbol")
    regime = F.when(F.col("vol") < F.col("_a"), 0).when(F.col("vol") < F.col("_b"), 1).otherwise(2)
    return j.groupBy("symbol", regime.alias("regime")).agg((F.avg("ret") * 252).alias("drift"), F.avg("vol").alias("mean_vol"), F.count(F.lit(1)).alias("n"))


def multi_coin(rets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drift and vol per symbol, correlation) after aligning the series from their ends."""
    a = align_from_end(rets)
    stats = a.groupBy("symbol").agg((F.avg("ret") * 252).alias("drift"), (F.stddev_pop("ret") * math.sqrt(252)).alias("vol"))
    return stats, correlation(a.select("symbol", F.col("back").alias("ts"), "ret"))


def peg_reversion(bars: DataFrame, peg: float, split=False) -> DataFrame:
    """-252 cov(r, log(P_prev / peg)) / var, and calm/stress volatility (25/95% of the 10-row volatility)."""
    r = log_return(bars, split=split)
    r = over_rows(r, ("symbol",), ["ts"], 1, lambda w: {"dev": F.log(F.lag("close").over(w) / peg)}, split=split).where("ret is not null")
    speed = r.groupBy("symbol").agg((-252 * F.covar_samp("ret", "dev") / F.var_pop("dev")).alias("reversion"))
    v = rolling(r, 10, "ret", {"vol": F.stddev_samp("ret")}, split=split).withColumn("vol", F.col("vol") * math.sqrt(252))
    return speed.join(quantiles(v, ["symbol"], "vol", {"calm_vol": .25, "stress_vol": .95}, split=split), "symbol")


def candidate_scores(candidates: DataFrame, assets: DataFrame, variance: DataFrame, rf: float = 0.02) -> DataFrame:
    """Sharpe minus liquidity, regulatory and concentration terms per candidate weight set."""
    x = candidates.join(assets, "symbol").groupBy("candidate").agg(
        F.sum(F.col("w") * F.col("expected")).alias("r"), F.sum(F.col("w") * F.col("liquidity")).alias("l"),
        F.sum(F.col("w") * F.col("regulatory")).alias("g"), F.sum(F.col("w") * F.col("w")).alias("h")).join(variance, "candidate")
    score = (F.col("r") - rf) / F.sqrt("variance") - 0.1 * F.col("l") - 0.05 * F.col("g") - 0.1 * F.col("h")
    return x.select("candidate", score.alias("score"))


def path_expectations(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected total return per asset and covariance of the cross-path mean step returns.
    `paths`: asset, path_id, step, price."""
    ends = paths.groupBy("asset", "path_id").agg(F.min_by("price", "step").alias("a"), F.max_by("price", "step").alias("b"))
    total = ends.groupBy("asset").agg(F.avg(F.col("b") / F.col("a") - 1).alias("expected"))
    from tidemark.operators.aggregate import covariance
    r = over_rows(paths, ["asset", "path_id"], ["step"], 1, lambda w: {"r": F.col("price") / F.lag("price").over(w) - 1})
    mean = r.where("r is not null").groupBy(F.col("asset").alias("symbol"), F.col("step").alias("ts")).agg(F.avg("r").alias("ret"))
    return total, covariance(mean)
