"""Signals, order execution, ledgers and result tables of backtests."""
from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import indicators as I
from tidemark.operators.aggregate import kurt_unbiased, skew_unbiased
from tidemark.plans.ordered import over_rows, running, stepwise
from tidemark.plans.ranges import in_ranges, scan_levels

K = ("symbol",)


def rebalance_dates(bars: DataFrame, frequency: str, keys=K) -> DataFrame:
    """Daily, Mondays or calendar month ends; the first day always counts. First days are one row per key."""
    rule = {"daily": F.lit(True), "weekly": F.weekday("ts") == 0, "monthly": F.to_date("ts") == F.last_day("ts")}[frequency]
    first = bars.groupBy(*keys).agg(F.min("ts").alias("_first"))
    return bars.join(first, list(keys)).where(rule | (F.col("ts") == F.col("_first"))).drop("_first")


def momentum_signal(bars: DataFrame, n: int = 20, cut: float = 0.02, keys=K, split=False) -> DataFrame:
    """`signal`: 1 when the close rose more than `cut` over n rows, -1 when it fell more, else 0."""
    df = over_rows(bars, keys, ["ts"], n - 1, lambda w: {"momentum": F.col("close") / F.lag("close", n - 1).over(w) - 1}, split=split)
    return df.withColumn("signal", F.when(F.col("momentum") > cut, 1).when(F.col("momentum") < -cut, -1).otherwise(0))


def execute_signals(signals: DataFrame, keys=K, capital: float = 100_000.0, lot: float = 100.0, commission: float = 0.001,
                    slippage: float = 0.0005) -> DataFrame:
    """Value each day before its trade, then buy `lot` or sell everything held.

    Orders without cash or shares are rejected. Every run (strategy x symbol) streams in time order;
    thousands of runs proceed in parallel.
    """
    def advance(state, px, sig):
        cash, qty, avg = state
        equity = cash + qty * px
        if sig > 0:
            cost = lot * px * (1 + commission + slippage)
            if cash >= cost:
                avg = (qty * avg + lot * px) / (qty + lot) if qty > 0 else px
                state = (cash - cost, qty + lot, avg)
                return state, (equity, *state[:2], "buy", lot, lot * px * commission, 0.0)
        elif sig < 0 and qty > 0:
            state = (cash + qty * px * (1 - commission - slippage), 0.0, 0.0)
            return state, (equity, *state[:2], "sell", qty, qty * px * commission, qty * (px - avg))
        return state, (equity, cash, qty, None, 0.0, 0.0, 0.0)

    return stepwise(signals, keys, ["ts"], lambda: (capital, 0.0, 0.0), advance, ["close", "signal"], [*keys, "ts", "close"],
                    "equity double, cash double, quantity double, action string, traded double, commission double, realized double")


def run_strategy(bars: DataFrame, strategy: Callable[[np.ndarray], int], lookback: int, keys=K, **costs) -> DataFrame:
    """User strategy f(closes) -> -1, 0 or 1. It sees at most `lookback` closes up to the current row,
    so no look-ahead is possible and state stays bounded; execution is `execute_signals`."""
    def advance(state, px):
        state.append(px)
        return state, (int(strategy(np.array(state))),)

    signals = stepwise(bars, keys, ["ts"], lambda: deque(maxlen=lookback), advance, ["close"], [*keys, "ts", "close"], "signal int")
    return execute_signals(signals, keys, **costs)


def _after(held, avg, action, q, p):
    """Quantity, average cost and realized gain after one fill."""
    if action == "buy":
        return held + q, (held * avg + q * p) / (held + q) if held > 0 else p, 0.0
    left = held - q
    return (left, avg, q * (p - avg)) if left > 1e-8 else (0.0, 0.0, q * (p - avg))


FILL = ["portfolio", "symbol", "ts", "action", "quantity", "price"]


def execute_orders(orders: DataFrame, capital: float = 1_000_000.0, commission: float = 0.001, slippage: float = 0.0) -> DataFrame:
    """Orders of many symbols per portfolio against one cash account, in (ts, seq) order. State is the
    cash and one entry per held symbol."""
    def advance(state, symbol, action, q, p):
        cash, book = state
        held, avg = book.get(symbol, (0.0, 0.0))
        value = q * p
        cost = value * (commission + slippage)
        if not (cash >= value + cost if action == "buy" else held >= q):
            return state, (False, cash, held, avg, 0.0)
        held, avg, gain = _after(held, avg, action, q, p)
        cash += -value - cost if action == "buy" else value - cost
        if held:
            book[symbol] = (held, avg)
        else:
            book.pop(symbol, None)
        return (cash, book), (True, cash, held, avg, gain)

    return stepwise(orders, ["portfolio"], ["ts", "seq"], lambda: (capital, {}), advance, ["symbol", "action", "quantity", "price"], FILL,
                    "accepted boolean, cash double, held double, avg_price double, realized double")


def average_cost(trades: DataFrame, keep=FILL) -> DataFrame:
    """Running quantity, average cost and realized gain per (portfolio, symbol), beside the columns `keep` of the
    fills; a position at or below 1e-8 is removed, so a sale without shares leaves nothing behind. `n` numbers the
    fills of a position.

    Two scans over sorted ranges, so a position with many fills lies in many tasks: holdings are running
    sums that a sale cannot bring below zero; given them, a fill maps the average cost x to a x + b. The sorted
    fills are written once; the ledger is computed where it is read.
    """
    keys, inputs = ["portfolio", "symbol"], ["_buy", "_q", "_p"]

    def holdings(c):
        return np.where(c["_buy"], c["_q"], -c["_q"]), np.where(c["_buy"], -np.inf, 0.0)

    def cost(c):
        had = np.where(c["_had"] <= 1e-8, 0.0, c["_had"])
        more, any_held, left = had + c["_q"], ~(had <= 0), ~(had - c["_q"] <= 1e-8)
        return (np.where(c["_buy"], np.where(any_held, had / more, 0.0), np.where(left, 1.0, 0.0)),
                np.where(c["_buy"], np.where(any_held, c["_q"] * c["_p"] / more, c["_p"]), 0.0))

    fills = trades.withColumns({"_buy": F.coalesce(F.col("action") == "buy", F.lit(False)), "_q": F.col("quantity").cast("double"), "_p": F.col("price").cast("double")})
    x = in_ranges(fills.select(*dict.fromkeys([*FILL, *keep, "seq", *inputs])), keys, ["ts", "seq"], list(dict.fromkeys([*keys, *keep, *inputs])))
    x = scan_levels(x, keys, inputs, [{"_had": ("reflect", holdings, 0.0), "n": ("affine", lambda c: (1.0, 1.0), 0.0)}, {"_avg": ("affine", cost, 0.0)}], after=["_avg"])
    buy, q, zero, had = F.col("_buy"), F.col("_q"), F.lit(0.0), F.when(F.col("_had") > 1e-8, F.col("_had")).otherwise(F.lit(0.0))
    held = F.when(buy, had + q).when(had - q > 1e-8, had - q).otherwise(zero)
    return x.select(*keep, held.alias("held"), F.col("_after__avg").alias("avg_price"), F.when(buy, zero).otherwise(q * (F.col("_p") - F.col("_avg"))).alias("realized"), F.col("n").cast("long").alias("n"))


def positions_summary(ledger: DataFrame, prices: DataFrame, order: str = "n") -> DataFrame:
    """Open positions at the end with market value and gains: last ledger row per position."""
    last = ledger.groupBy("portfolio", "symbol").agg(F.max_by("held", order).alias("held"), F.max_by("avg_price", order).alias("avg_price"), F.sum("realized").alias("realized"))
    p = last.where("held > 0").join(prices, "symbol", "left").select("portfolio", "symbol", "held", "avg_price", "price", "realized")
    return p.withColumns({"market_value": F.col("held") * F.col("price"), "unrealized": F.col("held") * (F.col("price") - F.col("avg_price"))})


def equity_metrics(curve: DataFrame, capital: Column | None = None, rf: float = 0.02, keys=K, split=False) -> DataFrame:
    """Return, annualized return, volatility, Sharpe, drawdown, Calmar, Sortino, VaR95 of equity curves."""
    x = I.drawdown(I.simple_return(curve, "equity", "ret", keys, split), "equity", keys, split)
    r = F.col("ret")
    start = F.min_by("equity", "ts") if capital is None else F.first(capital)
    g = x.groupBy(*keys).agg(start.alias("initial"), F.max_by("equity", "ts").alias("final"), F.count(F.lit(1)).alias("days"), F.stddev_samp("ret").alias("_s"),
                             F.avg("ret").alias("_m"), F.stddev_samp(F.when(r < 0, r)).alias("_d"), F.min("drawdown").alias("max_drawdown"),
                             F.percentile("ret", [0.05, 0.01, 0.10]).alias("_q"))
    root, zero = F.sqrt(F.lit(252.0)), F.lit(0.0)
    ann = F.pow(F.col("final") / F.col("initial"), 252 / F.col("days")) - 1
    g = g.withColumns({"total_return": F.col("final") / F.col("initial") - 1, "annualized_return": ann, "volatility": F.col("_s") * root})
    return g.select(*keys, "initial", "final", "days", "total_return", "annualized_return", "volatility",
                    F.coalesce(F.try_divide(F.col("_m") - rf / 252, F.col("_s")) * root, zero).alias("sharpe"), "max_drawdown",
                    F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs("max_drawdown")).otherwise(zero).alias("calmar"),
                    F.coalesce(F.try_divide(F.col("annualized_return") - rf, F.col("_d") * root), zero).alias("sortino"),
                    F.col("_q")[0].alias("var_95"), F.col("_q")[1].alias("var_99"), F.col("_q")[2].alias("var_90"))


def match_trades(trades: DataFrame, keys=("portfolio", "symbol"), order=("ts", "seq"), split=None) -> DataFrame:
    """Each sell with the latest buy before it in trade order; pnl = (sell - buy) x quantity."""
    x = trades.withColumn("_b", F.when(F.col("action") == "buy", F.struct("ts", "price")))
    x = running(x, list(keys), list(order), {"_buy": ("last", F.col("_b"))}, split=split)
    x = x.where((F.col("action") == "sell") & F.col("_buy").isNotNull())
    return x.select(*keys, "ts", "quantity", "price", F.col("_buy.price").alias("buy_price"), F.col("_buy.ts").alias("buy_ts"),
                    ((F.col("price") - F.col("_buy.price")) * F.col("quantity")).alias("pnl"))


def trade_statistics(matched: DataFrame, trades: DataFrame, keys=("portfolio",)) -> DataFrame:
    """Trades, win rate, profit factor = mean win / mean loss (a missing loss counts as 1)."""
    n = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_trades"), F.date_diff(F.max("ts"), F.min("ts")).alias("days"))
    p = F.col("pnl")
    g = matched.groupBy(*keys).agg(F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("_w"), F.avg(F.when(p < 0, p)).alias("_l"))
    g = g.withColumn("profit_factor", F.coalesce("_w", F.lit(0.0)) / F.coalesce(F.abs("_l"), F.lit(1.0))).drop("_w", "_l")
    out = n.join(g, list(keys), "left").na.fill(0.0, ["win_rate", "profit_factor"])
    return out.withColumn("trades_per_month", F.when(F.col("days") > 0, F.col("num_trades") / (F.col("days") / 30)).otherwise(0.0))


def holding_periods(trades: DataFrame, keys=("portfolio", "symbol"), split=None) -> DataFrame:
    """Average days from the last buy strictly before each sell."""
    from tidemark.operators.align import asof
    sells, buys = trades.where("action = 'sell'"), trades.where("action = 'buy'")
    j = asof(sells, buys.select(*keys, "ts", "seq"), list(keys), F.col("ts"), ["ts", "seq"], strict=True, split=split)
    return j.where("asof is not null").groupBy(keys[0]).agg(F.avg(F.date_diff("ts", "asof")).alias("avg_holding_days"))


def return_analysis(curve: DataFrame, keys=K) -> DataFrame:
    """Monthly return statistics of equity curves."""
    m = I.monthly_return(curve, "equity", keys).where("ret is not null")
    return m.groupBy(*keys).agg(F.stddev_samp("ret").alias("monthly_volatility"), F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"),
                                F.count_if(F.col("ret") > 0).alias("positive_months"), F.count_if(F.col("ret") < 0).alias("negative_months"),
                                skew_unbiased("ret").alias("skew"), kurt_unbiased("ret").alias("kurt"))


def risk_analysis(curve: DataFrame, keys=K, split=False) -> DataFrame:
    """Metrics plus expected shortfall and the longest losing run."""
    from tidemark.operators.risk import expected_shortfall
    r = I.simple_return(curve, "equity", "ret", keys, split).where("ret is not null")
    es = expected_shortfall(r, keys=keys, levels=(0.95,), split=split).select(*keys, F.col("es_95").alias("expected_shortfall_95"))
    return equity_metrics(curve, keys=keys, split=split).join(es, list(keys)).join(I.longest_losing_run(r, keys=keys, split=split), list(keys))
