"""Weights, quadratic-form risk, attribution, rebalancing and candidate evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.mathx import z_value
from tidemark.operators.aggregate import symmetric
from tidemark.operators.regression import ols
from tidemark.plans.session import materialized

Z95 = z_value(0.05)


def normalize(pos: DataFrame, weight="weight", key="portfolio") -> DataFrame:
    """Divide by the sum per portfolio; a non-positive sum leaves the weights alone. The sum is a
    combined aggregate joined back, so a large portfolio is not gathered in one window."""
    total = pos.groupBy(key).agg(F.sum(weight).alias("_t"))
    return pos.join(total, key).withColumn(weight, F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(F.col(weight))).drop("_t")


def marginal(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(Σw)_i and Σ_ii per (portfolio, symbol); `cov` holds pairs i<=j with their diagonal, and is read once."""
    full = symmetric(cov, "cov")
    w = weights.select("portfolio", F.col("symbol").alias("sym_j"), F.col("weight").alias("wj"))
    row = (w.join(full, "sym_j").groupBy("portfolio", F.col("sym_i").alias("symbol"))
           .agg(F.sum(F.col("cov") * F.col("wj")).alias("sw"), F.max(F.when(F.col("sym_i") == F.col("sym_j"), F.col("cov"))).alias("var")))
    return weights.join(row, ["portfolio", "symbol"])


def portfolio_risk(weights: DataFrame, cov: DataFrame, bump: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(portfolio rows, asset rows): VaR, diversification, concentration; marginal, component, share
    of variance and incremental VaR.

    Raising w_k by `bump` and renormalizing changes the variance to
    (w'Σw + 2 bump (Σw)_k + bump² Σ_kk) / (W + bump)², so no second quadratic form is needed.
    """
    m = materialized(marginal(weights, cov))  # read twice below; the covariance behind it is not
    top = m.groupBy("portfolio").agg(
        F.sum(F.col("weight") * F.col("sw")).alias("variance"), F.sum("weight").alias("_w"),
        F.sum(F.col("weight") * F.sqrt("var")).alias("_wv"), F.sum(F.col("weight") * F.col("weight")).alias("concentration"))
    top = top.withColumn("volatility", F.sqrt("variance"))
    port = top.select("portfolio", "volatility", (-Z95 * F.col("volatility")).alias("var_95"),
                      F.try_divide(F.col("_wv"), F.col("volatility")).alias("diversification"), "concentration")
    a = m.join(top.select("portfolio", "variance", "volatility", "_w"), "portfolio")
    marg = F.try_divide(F.col("sw"), F.col("volatility"))
    bumped = F.sqrt(F.col("variance") + 2 * bump * F.col("sw") + bump * bump * F.col("var")) / (F.col("_w") + bump)
    assets = a.select("portfolio", "symbol", marg.alias("marginal"), (F.col("weight") * marg).alias("component"),
                      F.try_divide(F.col("weight") * F.col("sw"), F.col("variance")).alias("share"),
                      (-Z95 * (bumped - F.col("volatility"))).alias("incremental"))
    return port, assets


def exposure_shares(pos: DataFrame, prices: DataFrame, cov: DataFrame, default: float = 100.0) -> DataFrame:
    """Risk shares weighted by market value over total absolute market value."""
    v = pos.join(prices, "symbol", "left").withColumn("_mv", F.col("quantity") * F.coalesce("price", F.lit(default)))
    tot = v.groupBy("portfolio").agg(F.sum(F.abs("_mv")).alias("_t"))
    w = v.join(tot, "portfolio").where("_t > 0").select("portfolio", "symbol", (F.col("_mv") / F.col("_t")).alias("weight"))
    return portfolio_risk(w, cov)[1].select("portfolio", "symbol", "share")


def brinson(port: DataFrame, bench: DataFrame, keys=("portfolio",)) -> DataFrame:
    """Allocation, selection, interaction per portfolio sector: port(keys, sector, wp, rp), bench(sector, wb, rb)."""
    z = F.lit(0.0)
    j = port.join(bench, "sector", "left").withColumns({c: F.coalesce(c, z) for c in ("wp", "rp", "wb", "rb")})
    alloc = (F.col("wp") - F.col("wb")) * F.col("rb")
    sel = F.col("wb") * (F.col("rp") - F.col("rb"))
    inter = (F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))
    return j.select(*keys, "sector", alloc.alias("allocation"), sel.alias("selection"), inter.alias("interaction"),
                    (alloc + sel + inter).alias("total"))


def factor_attribution(rets: DataFrame, exposures: DataFrame, factors: DataFrame) -> DataFrame:
    """Σ exposure x factor return per factor, and what is left as 'specific'."""
    own = rets.groupBy("portfolio", "ts").agg(F.sum("ret").alias("ret"), F.count("ret").alias("n"))
    held = exposures.groupBy("portfolio", "ts").agg(F.collect_list(F.struct("factor", "exposure")).alias("exposures"))
    return attribute_rows(own.join(held, ["portfolio", "ts"], "full"), factors)


def attribute_rows(rows: DataFrame, factors: DataFrame, few_dates: bool = False) -> DataFrame:
    """`factor_attribution` of rows that hold their exposures: rows(portfolio, ts, ret, n, exposures), where `exposures` is an
    array of (factor, exposure), `ret` the sum of n returns, and n null where there is no return.

    What a portfolio's factors explain is taken from their sums, so contributions are never summed or joined per date.
    `few_dates`: the dates of `factors` are bounded by a calendar, and it goes to every task.
    """
    own = F.array(F.struct(F.lit(True).alias("rest"), F.lit(None).cast("string").alias("factor"), F.col("ret").cast("double").alias("exposure")))
    held = F.transform(F.coalesce("exposures", F.array()), lambda e: F.struct(F.lit(False).alias("rest"), e["factor"].alias("factor"), e["exposure"].cast("double").alias("exposure")))
    x = rows.select("portfolio", "ts", "n", F.explode(F.when(F.col("n").isNull(), held).otherwise(F.concat(own, held))).alias("e")).select("portfolio", "ts", "n", "e.*")
    known = factors.select("ts", "factor", "factor_ret", F.lit(True).alias("_known"))
    x = x.join(F.broadcast(known) if few_dates else known, ["ts", "factor"], "left").where("rest or _known")
    c = F.when(F.col("rest"), F.col("exposure")).otherwise(F.col("exposure") * F.col("factor_ret"))
    sums = x.groupBy("portfolio", "rest", "factor").agg(F.sum(c).alias("c"), F.sum(F.col("n") * c).alias("e"))
    named = F.collect_list(F.when(~F.col("rest"), F.struct("factor", F.col("c").alias("contribution"))))  # a row per factor
    left = F.sum(F.when(F.col("rest"), F.col("c"))) - F.coalesce(F.sum(F.when(~F.col("rest"), F.col("e"))), F.lit(0.0))
    both = sums.groupBy("portfolio").agg(named.alias("named"), F.max("rest").alias("any"), F.struct(F.lit("specific").alias("factor"), left.alias("contribution")).alias("left"))
    return both.select("portfolio", F.explode(F.when(F.col("any"), F.concat("named", F.array("left"))).otherwise(F.col("named"))).alias("p")).select("portfolio", "p.*")


def style_attribution(df: DataFrame, factors: list[str], ret="ret", key="portfolio") -> DataFrame:
    """OLS on the style columns: alpha x n and beta x Σf per factor."""
    fit = ols(df, [key], ret, factors)
    sums = df.groupBy(key).agg(*[F.sum(f).alias(f) for f in factors])
    j = fit.join(sums, key)
    rows = [F.struct(F.lit("alpha").alias("factor"), (F.col("coef")[0] * F.col("n")).alias("contribution"))] + [
        F.struct(F.lit(f).alias("factor"), (F.col("coef")[i + 1] * F.col(f)).alias("contribution")) for i, f in enumerate(factors)]
    return j.select(key, F.explode(F.array(*rows)).alias("e")).select(key, "e.*")


def current_weights(pos: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    v = pos.join(prices, "symbol").withColumn("market_value", F.col("quantity") * F.col("price"))
    total = (v.groupBy("portfolio").agg(F.sum("market_value").alias("_v")).join(cash, "portfolio", "left")
             .select("portfolio", (F.col("_v") + F.coalesce("cash", F.lit(0.0))).alias("total_value")))
    return v.join(total, "portfolio").select("portfolio", "symbol", "price", "market_value", "total_value",
                                             F.when(F.col("total_value") > 0, F.col("market_value") / F.col("total_value")).alias("weight"))


def rebalance(current: DataFrame, targets: DataFrame, drift: float = 0.05, min_trade: float = 0.01) -> DataFrame:
    """Trades of portfolios whose largest |weight - target| passes `drift`; small trades are skipped."""
    j = targets.join(current.select("portfolio", "symbol", "price", "total_value", "weight"), ["portfolio", "symbol"])
    gap = j.withColumn("_gap", F.col("target") - F.coalesce("weight", F.lit(0.0)))
    hot = gap.groupBy("portfolio").agg(F.max(F.abs("_gap")).alias("max_drift")).where(F.col("max_drift") > drift)
    t = gap.join(hot, "portfolio").withColumn("trade_value", F.col("_gap") * F.col("total_value"))
    return t.where(F.abs("trade_value") > F.col("total_value") * min_trade).select(
        "portfolio", "symbol", "trade_value", (F.col("trade_value") / F.col("price")).alias("quantity"), "max_drift")


def evaluate_candidates(rets: DataFrame, candidates: DataFrame, days: int = 252) -> DataFrame:
    """Return, volatility, Sharpe, VaR per candidate weight set; `rets` is dense on (ts, symbol)."""
    series = rets.join(candidates, "symbol").groupBy("candidate", "ts").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    out = series.groupBy("candidate").agg((F.avg("r") * days).alias("mean_return"), (F.stddev_pop("r") * F.sqrt(F.lit(float(days)))).alias("volatility"),
                                          F.percentile("r", [0.05, 0.01]).alias("_q"))
    return out.select("candidate", "mean_return", "volatility", F.try_divide(F.col("mean_return"), F.col("volatility")).alias("sharpe"),
                      F.col("_q")[0].alias("var_95"), F.col("_q")[1].alias("var_99"))


def weight_grid(spark, symbols: list[str], steps: int = 10) -> DataFrame:
    """All weight vectors on a grid that sum to 1, as (candidate, symbol, w). Its size depends on the
    number of listed symbols only."""
    out = spark.range(1).select(F.array().cast("array<int>").alias("a"), F.lit(steps).alias("rest"))
    for _ in symbols[:-1]:
        out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rest")))).select(
            F.concat("a", F.array("k")).alias("a"), (F.col("rest") - F.col("k")).alias("rest"))
    full = out.select(F.concat("a", F.array("rest")).alias("a"))
    return full.select(F.concat_ws("-", "a").alias("candidate"), F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in symbols]).alias("s"), F.col("a")))
                       .alias("e")).select("candidate", F.col("e.s").alias("symbol"), (F.col("e.a") / steps).alias("w"))


def frontier(evaluated: DataFrame, width: float) -> DataFrame:
    """Lowest volatility per bucket of the target return."""
    b = evaluated.withColumn("bucket", F.floor(F.col("mean_return") / width))
    return b.groupBy("bucket").agg(F.min_by(F.struct("candidate", "mean_return", "volatility"), F.struct("volatility", "candidate")).alias("b")).select("bucket", "b.*")


def risk_parity_scores(candidates: DataFrame, cov: DataFrame) -> DataFrame:
    """Variance and Σ(share - 1/n)² per candidate."""
    w = candidates.select(F.col("candidate").alias("portfolio"), "symbol", F.col("w").alias("weight"))
    m = marginal(w, cov)
    top = m.groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("sw")).alias("variance"), F.count(F.lit(1)).alias("_n"))
    g = m.join(top, "portfolio").withColumn("_d", F.col("weight") * F.col("sw") / F.col("variance") - 1 / F.col("_n"))
    return g.groupBy(F.col("portfolio").alias("candidate")).agg(F.first("variance").alias("variance"), F.sum(F.col("_d") * F.col("_d")).alias("parity_gap"))


def summary(current: DataFrame, trades_today: DataFrame | None = None) -> DataFrame:
    out = current.groupBy("portfolio").agg(F.sum("market_value").alias("exposure"), F.max("total_value").alias("total_value"),
                                           F.count(F.lit(1)).alias("positions"))
    out = out.withColumn("cash", F.col("total_value") - F.col("exposure"))
    if trades_today is not None:
        n = trades_today.groupBy("portfolio").agg(F.count(F.lit(1)).alias("trades"))
        out = out.join(n, "portfolio", "left").na.fill(0, ["trades"])
    return out
