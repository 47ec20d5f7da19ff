"""Backtest queries (BK, UD3)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import register, sql
from tidemark.operators import backtest as B
from tidemark.plans import frames as X

for _f, _c in (("daily", "true"), ("weekly", "isodow(ts) = 1"), ("monthly", "ts = last_day(ts)")):
    register(f"BK1_rebalance_{_f}", lambda s, d, f=_f: B.rebalance_dates(X.suppliers(s, d), f).select("symbol", "ts"),
             sql("sb", f"select symbol, ts from (select *, min(ts) over (partition by symbol) m from sb) where {_c} or ts = m"))
SIG = "select symbol, ts, close / lag(close, 19) over (partition by symbol order by ts) - 1 momentum, close from sb"
register("BK2_momentum_signal", lambda s, d: B.momentum_signal(X.suppliers(s, d)).select("symbol", "ts", "momentum", "signal"),
         sql("sb", "select symbol, ts, momentum, (case when momentum > 0.02 then 1 when momentum < -0.02 then -1 else 0 end)::int signal from m", m=SIG), "momentum")
RUNS = lambda s, d: B.execute_signals(B.momentum_signal(X.suppliers(s, d)), capital=1_000_000.0, commission=0.00101237)
_EX = """, r AS (select symbol, 0::bigint i, null::timestamp ts, 0.0::double equity, 1000000.0::double cash, 0.0::double qty, 0.0::double avg, null::varchar "action", 0.0::double realized from (select distinct symbol from sb)
  union all select symbol, i, ts, cash + qty * close, cash - case when b then 100 * close * 1.00151237::double else 0 end + case when sl then qty * close * 0.99848763::double else 0 end,
  case when sl then 0 when b then qty + 100 else qty end, case when sl then 0 when b then (qty * avg + 100 * close) / (qty + 100) else avg end,
  case when b then 'buy' when sl then 'sell' end, case when sl then qty * (close - avg) else 0 end from (select s.symbol, s.i, s.ts, s.close, r.cash, r.qty, r.avg, s.sig > 0 and r.cash >= 100 * s.close * 1.00151237::double b, s.sig < 0 and r.qty > 0 sl
  from r join s on s.symbol = r.symbol and s.i = r.i + 1))"""
_S = "select symbol, ts, close, row_number() over (partition by symbol order by ts) i, case when momentum > 0.02 then 1 when momentum < -0.02 then -1 else 0 end sig from m"


def _rec(tail):
    return "WITH RECURSIVE " + sql("sb", "", m=SIG, s=_S)[5:] + _EX + tail


register("BK3_execute_signals", lambda s, d: RUNS(s, d).select("symbol", "ts", "action", "cash", "quantity", "realized"),
         _rec(" select symbol, ts, \"action\", cash, qty quantity, realized from r where i > 0"), "cash:4 quantity realized:8")
register("BK5_equity_curve", lambda s, d: RUNS(s, d).select("symbol", "ts", "equity"), _rec(" select symbol, ts, equity from r where i > 0"), "equity:4")
register("BK3_execute_orders", lambda s, d: B.execute_orders(X.trades(s, d)), None, "cash:4 realized:4")
_AC = """WITH RECURSIVE """ + sql("tr", "", t="select *, row_number() over (partition by portfolio, symbol order by ts, seq) i from tr")[5:] + """, r AS (select portfolio, symbol, i, ts, "action", quantity, price,
  case when "action" = 'buy' then quantity else 0 end held, case when "action" = 'buy' then price else 0 end avg_price, case when "action" = 'buy' then 0 else quantity * price end realized from t where i = 1 union all
  select t.portfolio, t.symbol, t.i, t.ts, t."action", t.quantity, t.price, case when t."action" = 'buy' then r.held + t.quantity when r.held - t.quantity <= 1e-8 then 0 else r.held - t.quantity end,
  case when t."action" = 'buy' then case when r.held > 0 then (r.held * r.avg_price + t.quantity * t.price) / (r.held + t.quantity) else t.price end when r.held - t.quantity <= 1e-8 then 0 else r.avg_price end,
  case when t."action" = 'buy' then 0 else t.quantity * (t.price - r.avg_price) end from r join t on t.portfolio = r.portfolio and t.symbol = r.symbol and t.i = r.i + 1) """
register("BK4_average_cost", lambda s, d: B.average_cost(X.trades(s, d)).drop("n"), _AC + 'select portfolio, symbol, ts, "action", quantity, price, held, avg_price, realized from r', "price:9 avg_price:9 realized:8 held")
register("BK9_positions_summary",
         lambda s, d: B.positions_summary(B.average_cost(X.trades(s, d), ["portfolio", "symbol"]), X.last_prices(s, d)),
         _AC.rstrip() + ", " + sql("sb", "")[5:].strip() + """ select portfolio, symbol, held, avg_price, price, realized, held * price market_value, held * (price - avg_price) unrealized from (select portfolio, symbol, arg_max(held, i) held,
         arg_max(avg_price, i) avg_price, sum(realized) realized from r group by 1, 2) join (select symbol, arg_max(close, ts) price from sb group by 1) using (symbol) where held > 0""",
         "held avg_price:9 price:9 realized:8 market_value:8 unrealized:8")
CURVE = lambda s, d: X.suppliers(s, d).select("symbol", "ts", F.col("close").alias("equity"))
_R = "select symbol, ts, close, close / lag(close) over w - 1 ret, close / max(close) over w - 1 dd from sb window w as (partition by symbol order by ts)"
MET = """select symbol, initial, final, days, final / initial - 1 total_return, ann annualized_return, s * sqrt(252) volatility, (m - 0.02 / 252) / s * sqrt(252) sharpe, max_drawdown, ann / abs(max_drawdown) calmar,
  (ann - 0.02) / (dn * sqrt(252)) sortino, var_95, var_99, var_90 from (select symbol, arg_min(close, ts) initial, arg_max(close, ts) AS final, count(*) AS days, pow(arg_max(close, ts) / arg_min(close, ts), 252.0 / count(*)) - 1 ann,
  stddev_samp(ret) s, avg(ret) m, stddev_samp(ret) filter (ret < 0) dn, min(dd) max_drawdown, quantile_cont(ret, 0.05) var_95, quantile_cont(ret, 0.01) var_99, quantile_cont(ret, 0.1) var_90 from r group by 1)"""
_MC = "initial:9 final:9 total_return annualized_return volatility sharpe max_drawdown calmar sortino var_95 var_99 var_90"
register("BK6_result_metrics", lambda s, d: B.equity_metrics(CURVE(s, d)), sql("sb", MET, r=_R), _MC)
_O = "(partition by portfolio, symbol order by ts, seq)"
MT = f"select *, (price - bp) * quantity pnl from (select *, last_value(case when \"action\" = 'buy' then price end ignore nulls) over {_O} bp, last_value(case when \"action\" = 'buy' then ts end ignore nulls) over {_O} bt from tr) where \"action\" = 'sell' and bp is not null"
register("BK7_trade_matching", lambda s, d: B.match_trades(X.trades(s, d)),
         sql("tr", "select portfolio, symbol, ts, quantity, price, bp buy_price, bt buy_ts, pnl from m", m=MT), "price:9 buy_price:9 pnl:8")
register("BK7_win_rate", lambda s, d: B.trade_statistics(B.match_trades(X.trades(s, d)), X.trades(s, d)),
         sql("tr", """select portfolio, num_trades, days, coalesce(win_rate, 0) win_rate, coalesce(profit_factor, 0) profit_factor, case when days > 0 then num_trades / (days / 30) else 0 end trades_per_month from
         (select portfolio, count(*) num_trades, date_diff('day', min(ts), max(ts))::int AS days from tr group by 1) left join (select portfolio, avg((pnl > 0)::int) win_rate, coalesce(avg(pnl) filter (pnl > 0), 0) / coalesce(abs(avg(pnl) filter (pnl < 0)), 1) profit_factor
         from m group by 1) using (portfolio)""", m=MT), "win_rate profit_factor trades_per_month")
register("BK8_return_analysis", lambda s, d: B.return_analysis(CURVE(s, d)),
         sql("sb", """select symbol, stddev_samp(ret) monthly_volatility, max(ret) best_month, min(ret) worst_month, count(*) filter (ret > 0) positive_months, count(*) filter (ret < 0) negative_months, skewness(ret) skew, kurtosis(ret) kurt from
         (select symbol, last / lag(last) over (partition by symbol order by m) - 1 ret from (select symbol, date_trunc('month', ts) m, arg_max(close, ts) AS last from sb group by 1, 2)) where ret is not null group by 1"""),
         "monthly_volatility best_month worst_month skew kurt")
register("BK8_risk_analysis", lambda s, d: B.risk_analysis(CURVE(s, d)),
         sql("sb", f"""select e.*, x.es expected_shortfall_95, longest_losing_run from ({MET}) e join (select symbol, avg(ret) es from r join (select symbol, quantile_cont(ret, 0.05) q from r group by 1) using (symbol) where ret <= q group by 1) x using (symbol)
         join (select symbol, coalesce(max(n), 0) longest_losing_run from (select symbol, grp, count(*) n from (select symbol, ret, row_number() over (partition by symbol order by ts) - row_number() over (partition by symbol, ret < 0 order by ts) grp
         from r where ret is not null) where ret < 0 group by 1, 2) group by 1) using (symbol)""", r=_R), _MC + " expected_shortfall_95")
register("BK8_holding_periods", lambda s, d: B.holding_periods(X.trades(s, d)),
         sql("tr", """select portfolio, avg(date_diff('day', bt, ts)) avg_holding_days from (select s.portfolio, s.ts, max(b.ts) bt from tr s join tr b on b.portfolio = s.portfolio and b.symbol = s.symbol and b."action" = 'buy' and b.ts < s.ts
         where s."action" = 'sell' group by s.portfolio, s.ts, s.seq) group by 1"""), "avg_holding_days")


def _reversal(closes):
    """User strategy: buy below the mean of the seen closes, sell above it."""
    if len(closes) < 10:
        return 0
    return 1 if closes[-1] < 0.9 * closes.mean() else -1 if closes[-1] > 1.1 * closes.mean() else 0


register("UD3_user_strategy", lambda s, d: B.run_strategy(X.panel(s, d), _reversal, 20), None, "cash:3 equity:3")
