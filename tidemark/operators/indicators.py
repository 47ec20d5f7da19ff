"""Returns, rolling statistics, technical indicators and drawdowns.

Inputs are bars with one row per (symbol, ts), so the rows per symbol are bounded by
the calendar and one window per symbol is a bounded task; that is why `split` defaults
to False. Pass `split=True` for tick-level input: the same columns are then computed
block by block (see tidemark.plans.ordered).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.ordered import full_frame, over_rows, row_index, running

KEYS = ("symbol",)


def _lag(df, col, k, name, keys=KEYS, split=False):
    return over_rows(df, keys, ["ts"], k, lambda w: {name: F.lag(col, k).over(w)}, split=split)


def simple_return(df: DataFrame, price: str = "close", out: str = "ret", keys=KEYS, split=False) -> DataFrame:
    return over_rows(df, keys, ["ts"], 1,
                     lambda w: {out: F.try_divide(F.col(price), F.lag(price).over(w)) - 1}, split=split)


def log_return(df: DataFrame, price: str = "close", out: str = "ret", keys=KEYS, split=False) -> DataFrame:
    return over_rows(df, keys, ["ts"], 1,
                     lambda w: {out: F.log(F.try_divide(F.col(price), F.lag(price).over(w)))}, split=split)


def cumulative_return(df: DataFrame, ret: str = "ret", keys=KEYS, split=False) -> DataFrame:
    out = running(df, keys, ["ts"], {"cum_ret": ("product", 1 + F.col(ret))}, split=split)
    return out.withColumn("cum_ret", F.col("cum_ret") - 1)


def rolling(df: DataFrame, n: int, col: str, stats: dict[str, Column], keys=KEYS, split=False) -> DataFrame:
    """Rolling aggregates over the last `n` rows, null until the frame is full. All share one sort."""
    def build(w):
        f = w.rowsBetween(-(n - 1), 0)
        return {name: full_frame(w, n, F.col(col), agg.over(f)) for name, agg in stats.items()}
    return over_rows(df, keys, ["ts"], n - 1, build, split=split)


def realized_volatility(df, n: int = 30, ret: str = "ret", **kw) -> DataFrame:
    out = rolling(df, n, ret, {"vol": F.stddev_samp(ret)}, **kw)
    return out.withColumn("vol", F.col("vol") * math.sqrt(252))


def sma(df, n: int, price: str = "close", **kw) -> DataFrame:
    return rolling(df, n, price, {"sma": F.avg(price)}, **kw)


def decayed_sum(df: DataFrame, q: float, value: Column, out: str, keys=KEYS, order: str = "ts", split=False) -> DataFrame:
    """`out` = sum of q^(age in rows) * value over all rows so far, without a sequential pass; adds the row number `_rn`.

    Rows are cut into blocks of m rows where q^m < 1e-17. Inside a block the weighted sum is a running sum scaled by
    q^j; only the block just before can still matter, because q^m is below double precision. `value` may use `_rn`.
    """
    m = max(math.ceil(math.log(1e-17) / math.log(q)), 2)
    rows = row_index(df, keys, [order], split=split)
    rows = rows.withColumn("_b", F.floor(F.col("_rn") / m)).withColumn("_j", (F.col("_rn") % m).cast("double"))
    w = Window.partitionBy(*keys, "_b").orderBy("_rn")
    scaled = value * F.pow(F.lit(q), -F.col("_j"))
    rows = rows.withColumn("_s", F.sum(scaled).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.pow(F.lit(q), F.lit(m - 1.0))
    if split is False:  # the block before, as a range frame: evaluated once a block, in the same shuffle
        near = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
        rows = rows.withColumn("_prev", F.sum(scaled).over(near) * last)
    else:
        rows = rows.join(rows.groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg((F.sum(scaled) * last).alias("_prev")), [*keys, "_b"], "left")
    num = F.col("_s") * F.pow(F.lit(q), F.col("_j")) + F.coalesce("_prev", F.lit(0.0)) * F.pow(F.lit(q), F.col("_j") + 1)
    return rows.withColumn(out, num).drop("_b", "_j", "_s", "_prev")


def ema(df: DataFrame, span: int, col: str = "close", out: str = "ema", keys=KEYS, split=False) -> DataFrame:
    """Normalized exponential mean (first value = first input)."""
    q = 1 - 2 / (span + 1)
    rows = decayed_sum(df, q, F.col(col), out, keys, split=split)
    return rows.withColumn(out, F.col(out) * (1 - q) / (1 - F.pow(F.lit(q), F.col("_rn") + 1))).drop("_rn")


def rsi(df: DataFrame, n: int = 14, price: str = "close", keys=KEYS, split=False) -> DataFrame:
    df = _lag(df, price, 1, "_prev", keys, split)
    change = F.coalesce(F.col(price) - F.col("_prev"), F.lit(0.0))
    df = df.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))})
    df = rolling(df, n, "_up", {"_gain": F.avg("_up"), "_loss": F.avg("_down")}, keys=keys, split=split)
    value = F.when(F.col("_loss") == 0, F.when(F.col("_gain") == 0, None).otherwise(F.lit(100.0))) \
        .otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return df.withColumn("rsi", value).drop("_prev", "_up", "_down", "_gain", "_loss")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, price: str = "close", **kw) -> DataFrame:
    df = rolling(df, n, price, {"middle": F.avg(price), "_sd": F.stddev_samp(price)}, **kw)
    return df.withColumns({"upper": F.col("middle") + k * F.col("_sd"),
                           "lower": F.col("middle") - k * F.col("_sd")}).drop("_sd")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close", **kw) -> DataFrame:
    df = ema(ema(df, fast, price, "_fast", **kw), slow, price, "_slow", **kw)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ema(df, signal, "macd", "signal", **kw).withColumn("histogram", F.col("macd") - F.col("signal"))


def rolling_summary(df: DataFrame, n: int = 20, col: str = "close", **kw) -> DataFrame:
    return rolling(df, n, col, {"mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col)}, **kw)


def rolling_var(df: DataFrame, n: int = 252, ret: str = "ret", **kw) -> DataFrame:
    """Rolling 95/99% VaR, population std and mean; only rows with a full window."""
    q = F.percentile(ret, [0.05, 0.01])
    df = rolling(df, n, ret, {"_q": q, "std": F.stddev_pop(ret), "mean": F.avg(ret)}, **kw)
    return df.where("_q is not null").withColumns({"var_95": F.col("_q")[0], "var_99": F.col("_q")[1]}).drop("_q")


def pair_returns(rets: DataFrame) -> DataFrame:
    """Every pair i<j at each ts: the output of a pairwise report, one row per pair and ts."""
    a = rets.select(F.col("symbol").alias("sym_i"), "ts", F.col("ret").alias("ri"))
    b = rets.select(F.col("symbol").alias("sym_j"), "ts", F.col("ret").alias("rj"))
    return a.join(b, "ts").where("sym_i < sym_j")


def rolling_correlation(rets: DataFrame, n: int = 60, split=False) -> DataFrame:
    return rolling(pair_returns(rets), n, "ri", {"corr": F.corr("ri", "rj")}, keys=("sym_i", "sym_j"),
                   split=split).where("corr is not null")


def drawdown(df: DataFrame, price: str = "close", keys=KEYS, split=False) -> DataFrame:
    df = running(df, keys, ["ts"], {"peak": ("max", F.col(price))}, split=split)
    return df.withColumn("drawdown", (F.col(price) - F.col("peak")) / F.col("peak"))


def runs(df: DataFrame, keys, flag: Column, order=("ts",), split=False) -> DataFrame:
    """Tag maximal runs of equal `flag` with `run` (number of changes so far)."""
    df = df.withColumn("_flag", flag)
    df = over_rows(df, keys, list(order), 1, lambda w: {"_was": F.lag("_flag").over(w)}, split=split)
    change = F.when(F.col("_was").eqNullSafe(F.col("_flag")), 0).otherwise(1)
    return running(df, keys, list(order), {"run": ("sum", change)}, split=split).drop("_was")


def drawdown_episodes(df: DataFrame, price: str = "close", keys=KEYS, split=False) -> DataFrame:
    """One row per drawdown: first row below the peak, first row back at it (or the last row), depth, days."""
    dd = drawdown(df, price, keys, split)
    dd = over_rows(dd, keys, ["ts"], 0, lambda w: {"_next": F.lead("ts").over(w)}, ahead=1, split=split)
    dd = runs(dd, keys, F.col("drawdown") < 0, split=split).where("_flag")
    # the episode ends at the first row at or above the peak, or stays open at the last row
    out = dd.groupBy(*keys, "run").agg(
        F.min("ts").alias("start"), F.max(F.coalesce("_next", "ts")).alias("end"),
        F.min("drawdown").alias("depth"), F.max(F.col("_next").isNull()).alias("open"))
    return out.withColumn("days", F.date_diff("end", "start")).drop("run")


def worst_drawdown(df: DataFrame, price: str = "close", keys=KEYS, split=False) -> DataFrame:
    """Depth, peak and trough time, rows from peak to trough, rows from trough to recovery."""
    dd = drawdown(row_index(df, keys, ["ts"], split=split), price, keys, split)
    trough = dd.groupBy(*keys).agg(
        F.min("drawdown").alias("max_drawdown"),
        F.min_by(F.struct("ts", "_rn", "peak"), F.struct("drawdown", "ts")).alias("_t"),
        F.max("_rn").alias("_last"))
    joined = dd.join(trough, list(keys))
    at_peak = (F.col(price) == F.col("_t.peak")) & (F.col("_rn") <= F.col("_t._rn"))
    healed = (F.col("_rn") > F.col("_t._rn")) & (F.col(price) >= F.col("_t.peak"))
    out = joined.groupBy(*keys).agg(
        F.first("max_drawdown").alias("max_drawdown"), F.first("_t").alias("_t"), F.first("_last").alias("_last"),
        F.min(F.when(at_peak, F.struct("_rn", "ts"))).alias("_p"), F.min(F.when(healed, F.col("_rn"))).alias("_h"))
    return out.select(*keys, "max_drawdown", F.col("_p.ts").alias("peak_ts"), F.col("_t.ts").alias("trough_ts"),
                      (F.col("_t._rn") - F.col("_p._rn")).alias("duration"),
                      (F.coalesce("_h", "_last") - F.col("_t._rn")).alias("recovery"))


def longest_losing_run(rets: DataFrame, ret: str = "ret", keys=KEYS, split=False) -> DataFrame:
    tagged = runs(rets, keys, F.col(ret) < 0, split=split)
    length = tagged.groupBy(*keys, "run").agg(F.count_if("_flag").alias("n"))
    return length.groupBy(*keys).agg(F.max("n").alias("longest_losing_run"))


def rank_transform(df: DataFrame, col: str, keys=KEYS, split=False) -> DataFrame:
    """rank(<= x) / (n + 1). Keys of bounded size are ranked in one window; with `split` values are counted first, so equal
    values travel once. Null values count, in front of all others, but get no row; nor do null keys."""
    if split is False:
        w = Window.partitionBy(*keys)
        upto = F.count(F.lit(1)).over(w.orderBy(col).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn("u", upto / (F.count(F.lit(1)).over(w) + 1)).na.drop("any", subset=[*keys]).where(F.col(col).isNotNull())
    freq = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(freq, keys, [col], {"_upto": ("sum", F.col("_n"))}, split=split)
    size = freq.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    u = cum.join(size, list(keys)).select(*keys, col, (F.col("_upto") / (F.col("_all") + 1)).alias("u"))
    return df.join(u, [*keys, col])


def volatility_flags(rets: DataFrame, n: int = 20, q: float = 0.95) -> DataFrame:
    """Dates whose mean rolling volatility exceeds the mean of the per-symbol q-quantiles."""
    vol = rolling(rets, n, "ret", {"vol": F.stddev_samp("ret")}).where("vol is not null")
    level = vol.groupBy("symbol").agg(F.percentile("vol", q).alias("_q")).agg(F.avg("_q").alias("level"))
    by_ts = vol.groupBy("ts").agg(F.avg("vol").alias("mean_vol"))
    return by_ts.join(F.broadcast(level)).where("mean_vol > level").select("ts", "mean_vol")  # level is one row


def rolling_beta(rets: DataFrame, bench: DataFrame, n: int = 20, split=False) -> DataFrame:
    """Sample covariance over population variance of the last n rows; 1.0 before n rows exist."""
    j = rets.join(bench, "ts")
    def build(w):
        f = w.rowsBetween(-(n - 1), 0)
        b = F.try_divide(F.covar_samp("ret", "bench_ret").over(f), F.var_pop("bench_ret").over(f))
        return {"beta": F.when(F.count("ret").over(f) == n, F.coalesce(b, F.lit(1.0))).otherwise(F.lit(1.0))}
    return over_rows(j, KEYS, ["ts"], n - 1, build, split=split)


def ewm_covariance(rets: DataFrame, decay: float = 0.94, seed_rows: int = 50, mean_rows: int = 10) -> DataFrame:
    """Exponentially weighted covariance at the last row of each pair.

    The recursion C <- decay*C + (1-decay)*d d' unrolls to one weighted sum, so no row order is
    needed inside the aggregate. d is the deviation from the mean over symbols of their mean
    of the last `mean_rows` returns; the seed is the sample covariance of the first rows.
    """
    r = rolling(rets, mean_rows, "ret", {"_m": F.avg("ret")})
    mid = r.groupBy("ts").agg(F.avg("_m").alias("mid"))
    p = row_index(pair_all(rets), ("sym_i", "sym_j"), ["ts"], split=False).join(mid, "ts")
    size = p.groupBy("sym_i", "sym_j").agg((F.max("_rn") + 1).alias("_n"))
    p = p.join(size, ["sym_i", "sym_j"])
    late = F.col("_rn") >= seed_rows
    dev = (F.col("ri") - F.col("mid")) * (F.col("rj") - F.col("mid"))
    age = F.col("_n") - 1 - F.col("_rn")
    steps = F.greatest(F.max("_n") - seed_rows, F.lit(0))
    out = p.groupBy("sym_i", "sym_j").agg(
        F.covar_samp(F.when(~late, F.col("ri")), F.when(~late, F.col("rj"))).alias("_seed"),
        F.sum(F.when(late, (1 - decay) * F.pow(F.lit(decay), age) * dev)).alias("_w"), steps.alias("_k"))
    return out.select("sym_i", "sym_j",
                      (F.pow(F.lit(decay), F.col("_k")) * F.col("_seed") + F.coalesce("_w", F.lit(0.0))).alias("cov"))


def pair_all(rets: DataFrame) -> DataFrame:
    a = rets.select(F.col("symbol").alias("sym_i"), "ts", F.col("ret").alias("ri"))
    b = rets.select(F.col("symbol").alias("sym_j"), "ts", F.col("ret").alias("rj"))
    return a.join(b, "ts").where("sym_i <= sym_j")


def autocorrelation(df: DataFrame, lags: list[int], col: str = "ret", keys=KEYS, split=False) -> DataFrame:
    """Correlation of the series with itself k rows earlier; every lag shares one window."""
    df = over_rows(df, keys, ["ts"], max(lags), lambda w: {f"_l{k}": F.lag(col, k).over(w) for k in lags}, split=split)
    wide = df.groupBy(*keys).agg(*[F.corr(col, f"_l{k}").alias(str(k)) for k in lags])
    return wide.unpivot(list(keys), [str(k) for k in lags], "lag", "rho").withColumn("lag", F.col("lag").cast("int"))


def cusum(df: DataFrame, col: str = "ret", keys=KEYS, split=False) -> DataFrame:
    mean = df.groupBy(*keys).agg(F.avg(col).alias("_mean"))
    j = df.join(mean, list(keys)).withColumn("_d", F.col(col) - F.col("_mean"))
    return running(j, keys, ["ts"], {"cusum": ("sum", F.col("_d"))}, split=split).drop("_mean", "_d")


def running_estimate(df: DataFrame, col: str, recent: int = 100, keys=KEYS, order=("ts",), split=False) -> DataFrame:
    """Running mean and the variance of its last `recent` values."""
    df = running(df, keys, list(order), {"_s": ("sum", F.col(col)), "_n": ("count", F.col(col))}, split=split)
    df = df.withColumn("running_mean", F.col("_s") / F.col("_n")).drop("_s", "_n")
    return over_rows(df, keys, list(order), recent - 1, lambda w: {
        "recent_var": F.var_pop("running_mean").over(w.rowsBetween(-(recent - 1), 0))}, split=split)


def monthly_return(df: DataFrame, price: str = "close", keys=KEYS) -> DataFrame:
    m = df.groupBy(*keys, F.date_trunc("month", "ts").alias("month")).agg(F.max_by(price, "ts").alias("last"))
    w = Window.partitionBy(*keys).orderBy("month")
    return m.withColumn("ret", F.col("last") / F.lag("last").over(w) - 1)


def rank_models(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average-tie ranks by AIC and BIC among the models of one key."""
    out = scores
    for c in ("aic", "bic"):
        w = Window.partitionBy(*keys)
        r = F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0
        out = out.withColumn(f"{c}_rank", r.cast("double"))
    return out
