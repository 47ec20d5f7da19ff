"""Filters and repairs for price bars."""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.bars import PRICES
from tidemark.plans.ordered import over_rows, quantiles, running

SYMBOL_PATTERN = r"^[A-Z]{1,5}(\.[A-Z]{1,2})?$"


def _all(conds) -> Column:
    return functools.reduce(lambda a, b: a & b, conds)


def date_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Inclusive range on the raw column, so the bound reaches the Parquet scan."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def drop_nonpositive(df: DataFrame, keep_null: bool = True) -> DataFrame:
    ok = [F.col(c) > 0 for c in PRICES]
    return df.where(_all([F.coalesce(c, F.lit(keep_null)) for c in ok]))


def clip_to_range(df: DataFrame) -> DataFrame:
    """open and close into [low, high]; a missing bound does not clip."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col("low")), F.col("high")))
                           for c in ("open", "close")})


def swap_high_low(df: DataFrame) -> DataFrame:
    bad = F.col("high") < F.col("low")
    return df.withColumns({"high": F.when(bad, F.col("low")).otherwise(F.col("high")),
                           "low": F.when(bad, F.col("high")).otherwise(F.col("low"))})


def repair_bounds(df: DataFrame) -> DataFrame:
    """high/low widened to hold open and close; a missing input makes the bound missing."""
    def bound(pick, c):
        known = _all([F.col(x).isNotNull() for x in (c, "open", "close")])
        return F.when(known, pick(F.col(c), F.col("open"), F.col("close")))
    return df.withColumns({"high": bound(F.greatest, "high"), "low": bound(F.least, "low")})


def dedupe(df: DataFrame, tie: str) -> DataFrame:
    """First row per (symbol, ts) by `tie`: min_by combines before the shuffle."""
    cols = [c for c in df.columns if c not in ("symbol", "ts")]
    return (df.groupBy("symbol", "ts").agg(F.min_by(F.struct(*cols), F.col(tie)).alias("_r"))
            .select("symbol", "ts", *[F.col(f"_r.{c}").alias(c) for c in cols]))


def fill_forward(df: DataFrame, cols=PRICES, keys=("symbol",), order=("ts",), split=False) -> DataFrame:
    return running(df, keys, order, {c: ("last", F.col(c)) for c in cols}, split=split)


def fill_missing_zero(df: DataFrame, split=False) -> DataFrame:
    return fill_forward(df, split=split).withColumn("volume", F.coalesce("volume", F.lit(0)))


def fill_missing_median(df: DataFrame, split=False) -> DataFrame:
    med = quantiles(df, ["symbol"], "volume", {"_med": 0.5}, split=split)
    out = fill_forward(df, split=split).join(med, "symbol", "left")
    return (out.withColumn("volume", F.coalesce(F.col("volume").cast("double"), "_med")).drop("_med")
            .where(F.col("close").isNotNull()))


def cap_outliers(df: DataFrame, z: float = 5.0, cols=PRICES, split=False) -> DataFrame:
    """Returns beyond z population sigmas are capped at the 1%/99% quantile and the price is
    rebuilt from the previous original price."""
    df = over_rows(df, ("symbol",), ["ts"], 1, lambda w: {
        **{f"_p_{c}": F.lag(c).over(w) for c in cols},
        **{f"_r_{c}": F.try_divide(F.col(c), F.lag(c).over(w)) - 1 for c in cols}}, split=split)
    if split is False:  # bounded keys: moments and quantiles are windows over the symbol, in the shuffle of the lags
        w = Window.partitionBy("symbol")
        df = df.withColumns({k: v for c in cols for k, v in ((f"_m_{c}", F.avg(f"_r_{c}").over(w)), (f"_s_{c}", F.stddev_pop(f"_r_{c}").over(w)),
                                                             (f"_q_{c}", F.percentile(f"_r_{c}", [0.01, 0.99]).over(w)))})
        df = df.withColumns({k: v for c in cols for k, v in ((f"_lo_{c}", F.col(f"_q_{c}")[0]), (f"_hi_{c}", F.col(f"_q_{c}")[1]))}).drop(*[f"_q_{c}" for c in cols])
    else:
        stats = df.groupBy("symbol").agg(
            *[a for c in cols for a in (F.avg(f"_r_{c}").alias(f"_m_{c}"), F.stddev_pop(f"_r_{c}").alias(f"_s_{c}"))])
        df = df.join(stats, "symbol")
        for c in cols:
            df = df.join(quantiles(df, ["symbol"], f"_r_{c}", {f"_lo_{c}": 0.01, f"_hi_{c}": 0.99}, split=split), "symbol", "left")
    out = {}
    for c in cols:
        r = F.col(f"_r_{c}")
        extreme = F.abs((r - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) > z
        out[c] = (F.when(extreme & (r > F.col(f"_hi_{c}")), F.col(f"_p_{c}") * (1 + F.col(f"_hi_{c}")))
                  .when(extreme & (r < F.col(f"_lo_{c}")), F.col(f"_p_{c}") * (1 + F.col(f"_lo_{c}"))).otherwise(F.col(c)))
    return df.withColumns(out).drop(*[f"_{p}_{c}" for c in cols for p in ("p", "r", "m", "s", "lo", "hi")])


def cap_returns(df: DataFrame, k: float = 3.0, split=False) -> DataFrame:
    """Close capped where its return leaves mean +- k sigma, rebuilt from the adjusted previous close.

    A capped row multiplies the row before it, an uncapped row restarts from its own close.
    So rows split into islands that start at an uncapped row; the adjusted close is the
    island's first close times the running product of the caps.
    """
    keys = ("symbol",)
    df = over_rows(df, keys, ["ts"], 1,
                   lambda w: {"_r": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1}, split=split)
    if split is False:
        w = Window.partitionBy(*keys)
        df = df.withColumns({"_m": F.avg("_r").over(w), "_s": F.stddev_samp("_r").over(w)})
    else:
        df = df.join(df.groupBy(*keys).agg(F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s")), list(keys))
    hi, lo = F.col("_m") + k * F.col("_s"), F.col("_m") - k * F.col("_s")
    df = df.withColumn("_f", F.when(F.col("_r") > hi, 1 + hi).when(F.col("_r") < lo, 1 + lo))
    df = running(df, keys, ["ts"], {"_isle": ("sum", F.when(F.col("_f").isNull(), 1).otherwise(0))}, split=split)
    step = F.coalesce("_f", "close")
    df = running(df, [*keys, "_isle"], ["ts"], {"close": ("product", step)}, split=split)
    return df.drop("_r", "_m", "_s", "_f", "_isle")


def coerce_types(df: DataFrame) -> DataFrame:
    """Prices to double, volume to nullable long; text that does not parse becomes null."""
    return df.withColumns({**{c: F.col(c).try_cast("double") for c in PRICES},
                           "volume": F.col("volume").try_cast("double").try_cast("long")})


def valid_symbols(df: DataFrame, col: str = "symbol") -> DataFrame:
    return df.where(F.upper(col).rlike(SYMBOL_PATTERN))


def finite_only(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def retain_recent(df: DataFrame, days: int = 30, now: Column | None = None, ts: str = "ts") -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def clean_a(df: DataFrame, tie: str, split=False) -> DataFrame:
    """dedupe -> forward fill, volume 0 -> z-score caps -> swap, clip, drop non-positive."""
    out = cap_outliers(fill_missing_zero(dedupe(df, tie), split=split), split=split)
    return drop_nonpositive(clip_to_range(swap_high_low(out)))


def clean_b(df: DataFrame, split=False) -> DataFrame:
    """repair bounds, drop non-positive -> forward fill, volume median -> 3 sigma cap -> types."""
    out = drop_nonpositive(repair_bounds(df), keep_null=False)
    return coerce_types(cap_returns(fill_missing_median(out, split=split), split=split))
