"""Prediction tables: scores, averaging weights, folds, stacking, importance."""
from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.indicators import decayed_sum
from tidemark.operators.regression import ols
from tidemark.plans.ordered import over_rows, row_index, running

def _err() -> Column:
    return F.col("y") - F.col("yhat")


def scores(pred: DataFrame, keys=("model",)) -> DataFrame:
    """MSE, MAE, RMSE, R² per model."""
    mse = F.avg(_err() * _err())
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), mse.alias("mse"), F.avg(F.abs(_err())).alias("mae"), F.sqrt(mse).alias("rmse"),
                                   (1 - mse / F.var_pop("y")).alias("r2"))


def averaging_weights(pred: DataFrame, fold: Column, likelihood: str = "gaussian", keys=("symbol",)) -> DataFrame:
    """Softmax over models of the mean fold log-likelihood."""
    n = F.count(F.lit(1))
    if likelihood == "gaussian":
        ll = -n / 2 * (F.log(2 * math.pi * F.avg(_err() * _err())) + 1)
    else:
        ll = -n * (F.log(2 * F.avg(F.abs(_err()))) + 1)
    per = pred.groupBy(*keys, "model", fold.alias("fold")).agg(ll.alias("ll")).groupBy(*keys, "model").agg(F.avg("ll").alias("score"))
    top = per.groupBy(*keys).agg(F.max("score").alias("_top"))
    x = per.join(top, list(keys)).withColumn("_e", F.exp(F.col("score") - F.col("_top")))
    tot = x.groupBy(*keys).agg(F.sum("_e").alias("_t"))
    return x.join(tot, list(keys)).select(*keys, "model", "score", (F.col("_e") / F.col("_t")).alias("weight"))


def combine(pred: DataFrame, weights: DataFrame, keys=("symbol",)) -> DataFrame:
    """Weighted prediction and weighted standard deviation between models."""
    j = pred.join(weights.select(*keys, "model", "weight"), [*keys, "model"])
    w, p = F.col("weight"), F.col("yhat")
    g = j.groupBy(*keys, "ts").agg(F.sum(w * p).alias("yhat"), F.sum(w * p * p).alias("_q"), F.max("y").alias("y"))
    return g.withColumn("between_std", F.sqrt(F.greatest(F.col("_q") - F.col("yhat") * F.col("yhat"), F.lit(0.0)))).drop("_q")


def adaptive_weights(pred: DataFrame, batch: Column, window: int = 10, rate: float = 0.1, keys=("symbol",)) -> DataFrame:
    """Inverse mean error over the last `window` batches, normalized over models, then blended."""
    b = pred.groupBy(*keys, "model", batch.alias("batch")).agg(F.avg(_err() * _err()).alias("mse"))
    b = over_rows(b, [*keys, "model"], ["batch"], window - 1, lambda w: {"_a": F.avg("mse").over(w.rowsBetween(-(window - 1), 0))}, split=False)
    b = b.withColumn("_i", 1 / (F.col("_a") + 1e-8))
    tot = b.groupBy(*keys, "batch").agg(F.sum("_i").alias("_t"))
    b = b.join(tot, [*keys, "batch"]).withColumn("new_weight", F.col("_i") / F.col("_t"))
    first = F.when(F.col("_rn") == 0, F.col("new_weight")).otherwise(rate * F.col("new_weight"))  # the blend starts at its first value
    out = decayed_sum(b, 1 - rate, first, "weight", [*keys, "model"], "batch")
    return out.select(*keys, "model", "batch", "new_weight", "weight")


def time_folds(df: DataFrame, folds: int, keys=("symbol",), split=False) -> DataFrame:
    """Consecutive blocks 0..folds in time order; block k tests a model trained on all blocks before it."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = row_index(df, keys, ["ts"], split=split).join(n, list(keys))
    test = F.floor(F.col("_n") / (folds + 1))
    start = F.col("_n") - folds * test
    return x.withColumn("fold", F.when(F.col("_rn") < start, 0).otherwise(F.floor((F.col("_rn") - start) / test) + 1).cast("int")).drop("_rn", "_n")


def cross_validate(df: DataFrame, x: str, y: str, folds: int = 5, keys=("symbol",)) -> DataFrame:
    """Time-ordered scores of a one-variable linear model: each fold uses sums over all earlier blocks."""
    f = time_folds(df, folds, keys)
    X, Y = F.col(x), F.col(y)
    s = f.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(X * Y).alias("sxy"), F.sum(Y * Y).alias("syy"))
    w = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    for c in ("n", "sx", "sy", "sxx", "sxy"):
        s = s.withColumn(f"t_{c}", F.sum(c).over(w))
    b = (F.col("t_n") * F.col("t_sxy") - F.col("t_sx") * F.col("t_sy")) / (F.col("t_n") * F.col("t_sxx") - F.col("t_sx") * F.col("t_sx"))
    a = (F.col("t_sy") - b * F.col("t_sx")) / F.col("t_n")
    s = s.where("fold > 0").withColumns({"slope": b, "intercept": a})
    i, k, n = F.col("intercept"), F.col("slope"), F.col("n")
    sse = F.col("syy") + n * i * i + k * k * F.col("sxx") - 2 * i * F.col("sy") - 2 * k * F.col("sxy") + 2 * i * k * F.col("sx")
    return s.select(*keys, "fold", "n", "slope", "intercept", (sse / n).alias("mse"))


def score_summary(cv: DataFrame, keys=("symbol",), z: float = 1.96) -> DataFrame:
    m, s = F.avg("mse"), F.stddev_pop("mse")
    half = z * s / F.sqrt(F.count(F.lit(1)))
    return cv.groupBy(*keys).agg(m.alias("mean"), s.alias("std"), (m - half).alias("low"), (m + half).alias("high"))


def rolling_scores(df: DataFrame, x: str, y: str, window: int, keys=("symbol",), split=False) -> DataFrame:
    """Fit on the previous `window` rows, predict the current one: squared error per row.

    The sums of a window are differences of running sums, centred by the key's means, so a row costs the same for any
    window."""
    keys = list(keys)
    if split is False:
        own = Window.partitionBy(*keys)
        df = df.withColumns({"_mx": F.avg(x).over(own), "_my": F.avg(y).over(own)})
    else:
        df = df.join(df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my")), keys)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(ok, F.col(x) - F.col("_mx")), F.when(ok, F.col(y) - F.col("_my"))
    sums = {"n": F.when(ok, F.lit(1.0)), "x": u, "y": v, "xx": u * u, "xy": u * v, "f": F.when(F.col(y).isNotNull(), F.lit(1.0))}
    df = running(df, keys, ["ts"], {f"_c{k}": ("sum", F.coalesce(c, F.lit(0.0))) for k, c in sums.items()}, split=split)
    lags = lambda w: {f"_d{k}": F.lag(f"_c{k}", 1).over(w) - F.coalesce(F.lag(f"_c{k}", window + 1).over(w), F.lit(0.0)) for k in sums}
    df = over_rows(df, keys, ["ts"], window + 1, lags, split=split)
    n, sx, sy = F.col("_dn"), F.col("_dx"), F.col("_dy")
    slope = F.try_divide(n * F.col("_dxy") - sx * sy, n * F.col("_dxx") - sx * sx)
    yhat = F.when(F.col("_df") == window, F.col("_my") + sy / n + slope * (F.col(x) - F.col("_mx") - sx / n))
    out = df.withColumn("yhat", yhat).drop("_mx", "_my", *[f"_{p}{k}" for k in sums for p in "cd"])
    return out.where("yhat is not null").withColumn("error2", (F.col(y) - F.col("yhat")) * (F.col(y) - F.col("yhat")))


def stack(folded: DataFrame, base: dict[str, str], y: str, keys: list[str]) -> DataFrame:
    """Out-of-fold predictions of one-variable base models, then a linear meta-model on them.

    base maps a model name to its input column. A fold's coefficients come from total sums minus its own.
    """
    aggs = []
    for c in base.values():
        X, Y = F.col(c), F.col(y)
        aggs += [F.sum(X).alias(f"sx_{c}"), F.sum(X * X).alias(f"sxx_{c}"), F.sum(X * Y).alias(f"sxy_{c}")]
    per = folded.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), *aggs)
    names = [c for c in per.columns if c not in (*keys, "fold")]
    tot = per.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    rest = per.join(tot, keys).select(*keys, "fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    out = {}
    for m, c in base.items():
        b = (F.col("n") * F.col(f"sxy_{c}") - F.col(f"sx_{c}") * F.col("sy")) / (F.col("n") * F.col(f"sxx_{c}") - F.col(f"sx_{c}") * F.col(f"sx_{c}"))
        out[f"_b_{m}"] = b
        out[f"_a_{m}"] = (F.col("sy") - b * F.col(f"sx_{c}")) / F.col("n")
    fit = rest.select(*keys, "fold", *[v.alias(k) for k, v in out.items()])
    meta = folded.join(fit, [*keys, "fold"]).withColumns({m: F.col(f"_a_{m}") + F.col(f"_b_{m}") * F.col(c) for m, c in base.items()})
    return ols(meta, keys, y, list(base))


def permutation_importance(df: DataFrame, cols: dict[str, float], intercept: float, y: str, order: list[str], split=None) -> DataFrame:
    """Rise of the MSE of a linear score when one column is reordered by a hash of the row's key.
    Both orders are exact positions, so the swap is one equi-join per column."""
    one = df.withColumn("_g", F.lit(1))
    at = row_index(one, ["_g"], order, "_at", split)
    yhat = F.lit(intercept)
    for c, b in cols.items():
        yhat = yhat + b * F.col(c)
    base = at.agg(F.avg((F.col(y) - yhat) * (F.col(y) - yhat)).alias("base"))
    mixed = row_index(at.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(o).cast("string") for o in order]))), ["_g"], ["_h", *order], "_to", split)
    out = None
    for c, b in cols.items():
        other = mixed.select(F.col("_to").alias("_at"), F.col(c).alias("_x"))
        j = at.join(other, "_at")
        e = F.col(y) - (yhat - b * F.col(c) + b * F.col("_x"))
        row = j.agg(F.avg(e * e).alias("mse")).join(F.broadcast(base)).select(F.lit(c).alias("feature"), (F.col("mse") - F.col("base")).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out


def rolling_metric(df: DataFrame, fn: Callable, cols: list[str], window: int, out: str = "metric", keys=("symbol",)) -> DataFrame:
    """User metric over the last `window` rows: fn(*series) -> float, run as a grouped pandas UDF on a bounded frame."""
    if len(cols) == 1:
        def one(a: pd.Series) -> float:
            return float(fn(a))
        udf = F.pandas_udf(one, "double")
    else:
        def two(a: pd.Series, b: pd.Series) -> float:
            return float(fn(a, b))
        udf = F.pandas_udf(two, "double")
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(window - 1), 0)
    return df.withColumns({out: udf(*[F.col(c) for c in cols]).over(w), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") == window).drop("_n")


def payoff(paths: DataFrame, expression: str, out: str = "payoff") -> DataFrame:
    """User payoff as a SQL expression over `path` (array<double>)."""
    return paths.withColumn(out, F.expr(expression))
