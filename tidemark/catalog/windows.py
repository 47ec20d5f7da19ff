"""Bars, returns, indicators and drawdowns (AG6, WN1-WN27)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import register, sql
from tidemark.operators import bars as B, indicators as I
from tidemark.plans import frames as X


def roll(n, part="symbol"):
    return f"(partition by {part} order by ts rows between {n - 1} preceding and current row)"


register("AG6_resample_daily", lambda s, d: B.resample(X.hourly(s, d), "D"),
         sql("db", "select * from db"), "open:9 high:9 low:9 close:9")
register("AG6_resample_weekly", lambda s, d: B.resample(X.panel(s, d), "W"),
         sql("pb", """select symbol, date_trunc('week', ts)::timestamp + interval 6 day AS ts, arg_min(open, ts) open, max(high) high,
         min(low) low, arg_max(close, ts) AS close, sum(volume)::bigint volume from pb group by 1, 2"""), "open:9 high:9 low:9 close:9")
register("AG6_resample_monthly", lambda s, d: B.resample(X.suppliers(s, d), "M"),
         sql("sb", """select symbol, last_day(ts)::timestamp AS ts, arg_min(open, ts) open, max(high) high,
         min(low) low, arg_max(close, ts) AS close, sum(volume)::bigint volume from sb group by 1, 2"""), "open:9 high:9 low:9 close:9")
register("WN1_simple_return", lambda s, d: I.simple_return(X.suppliers(s, d)).select("symbol", "ts", "ret"),
         sql("sb", "select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 ret from sb"), "ret")
register("WN2_log_return", lambda s, d: I.log_return(X.hourly(s, d)).select("symbol", "ts", "ret"),
         sql("hb", "select symbol, ts, ln(close / lag(close) over (partition by symbol order by ts)) ret from hb"), "ret")
register("WN3_cumulative_return",
         lambda s, d: I.cumulative_return(X.hourly_returns(s, d).withColumn("ret", F.col("ret") / 50)).select("symbol", "ts", "cum_ret"),
         sql("hr", "select symbol, ts, exp(sum(ln(1 + ret / 50)) over (partition by symbol order by ts)) - 1 cum_ret from hr"), "cum_ret")
register("WN4_realized_volatility", lambda s, d: I.realized_volatility(X.hourly_returns(s, d)).select("symbol", "ts", "vol"),
         sql("hr", f"select symbol, ts, case when count(ret) over {roll(30)} = 30 then stddev_samp(ret) over {roll(30)} * sqrt(252) end vol from hr"), "vol")
register("WN5_sma", lambda s, d: I.sma(X.suppliers(s, d), 20).select("symbol", "ts", "sma"),
         sql("sb", f"select symbol, ts, case when count(close) over {roll(20)} = 20 then avg(close) over {roll(20)} end sma from sb"), "sma")
_EMA = """select a.symbol, a.ts, sum(b.{c} * pow({q}, a.k - b.k)) / sum(pow({q}, a.k - b.k)) AS {o} from {t} a join {t} b
  on a.symbol = b.symbol and b.k <= a.k group by a.symbol, a.ts"""
register("WN6_ema", lambda s, d: I.ema(X.hourly(s, d), 12).select("symbol", "ts", "ema"),
         sql("dk", _EMA.format(c="close", q="(1 - 2/13.0::double)", t="dk", o="ema")), "ema")
register("WN7_rsi", lambda s, d: I.rsi(X.hourly(s, d)).select("symbol", "ts", "rsi"),
         sql("hb", f"""select symbol, ts, case when count(*) over {roll(14)} < 14 then null
           when avg(greatest(-c, 0)) over {roll(14)} = 0 then 100.0
           else 100 - 100 / (1 + avg(greatest(c, 0)) over {roll(14)} / avg(greatest(-c, 0)) over {roll(14)}) end rsi from ch""",
             ch="select symbol, ts, coalesce(close - lag(close) over (partition by symbol order by ts), 0) c from hb"), "rsi")
register("WN8_bollinger", lambda s, d: I.bollinger(X.hourly(s, d)).select("symbol", "ts", "middle", "upper", "lower"),
         sql("hb", "select symbol, ts, m middle, m + 2 * sd upper, m - 2 * sd lower from b",
             b=f"""select symbol, ts, case when count(*) over {roll(20)} = 20 then avg(close) over {roll(20)} end m,
             stddev_samp(close) over {roll(20)} sd from hb"""), "middle upper lower")
register("WN9_macd", lambda s, d: I.macd(X.hourly(s, d)).select("symbol", "ts", "macd", "signal", "histogram"),
         sql("dk", "select ts, symbol, macd, signal, macd - signal histogram from m2 join sg using (symbol, ts)",
             f=_EMA.format(c="close", q="(1 - 2/13.0::double)", t="dk", o="fast"),
             sl2=_EMA.format(c="close", q="(1 - 2/27.0::double)", t="dk", o="slow"),
             m2="select symbol, ts, fast - slow macd, row_number() over (partition by symbol order by ts) k from f join sl2 using (symbol, ts)",
             sg=_EMA.format(c="macd", q="(1 - 2/10.0::double)", t="m2", o="signal")), "macd signal histogram")
_PAIR = """select a.symbol sym_i, b.symbol sym_j, a.ts, a.ret ri, b.ret rj from {r} a join {r} b
  on a.ts = b.ts and a.symbol {op} b.symbol"""
register("WN10_rolling_correlation", lambda s, d: I.rolling_correlation(X.panel_returns(s, d)).select("sym_i", "sym_j", "ts", "corr"),
         sql("pr", "select sym_i, sym_j, ts, corr from z where n = 60", p=_PAIR.format(r="pr", op="<"),
             z=f"select *, corr(ri, rj) over {roll(60, 'sym_i, sym_j')} corr, count(*) over {roll(60, 'sym_i, sym_j')} n from p"), "corr")
register("WN11_rolling_summary", lambda s, d: I.rolling_summary(X.hourly(s, d)).select("symbol", "ts", "mean", "std", "min", "max"),
         sql("hb", """select symbol, ts, case when n = 20 then a end mean, case when n = 20 then b end std,
           case when n = 20 then c end "min", case when n = 20 then e end "max" from w""",
             w=f"""select symbol, ts, count(*) over r n, avg(close) over r a, stddev_samp(close) over r b, min(close) over r c,
             max(close) over r e from hb window r as {roll(20)}"""), "mean std min max")
register("WN12_rolling_var", lambda s, d: I.rolling_var(X.panel_returns(s, d)).select("symbol", "ts", "var_95", "var_99", "std", "mean"),
         sql("pr", "select symbol, ts, var_95, var_99, std, mean from w where n = 252",
             w=f"""select symbol, ts, count(*) over r n, quantile_cont(ret, 0.05) over r var_95, quantile_cont(ret, 0.01) over r var_99,
             stddev_pop(ret) over r std, avg(ret) over r mean from pr window r as {roll(252)}"""), "var_95 var_99 std mean")
_DD = "select symbol, ts, close, max(close) over (partition by symbol order by ts) peak, row_number() over (partition by symbol order by ts) k, lead(ts) over (partition by symbol order by ts) nx from {t}"
register("WN13_drawdown", lambda s, d: I.drawdown(X.suppliers(s, d)).select("symbol", "ts", "peak", "drawdown"),
         sql("sb", "select symbol, ts, peak, close / peak - 1 drawdown from w", w=_DD.format(t="sb")), "peak drawdown")
register("WN14_drawdown_episodes", lambda s, d: I.drawdown_episodes(X.suppliers(s, d)).drop("open"),
         sql("sb", """select symbol, start, "end", depth, date_diff('day', start, "end")::int AS days from (select symbol, min(ts) start,
           max(coalesce(nx, ts)) "end", min(close / peak - 1) depth from g where close < peak group by symbol, grp)""",
             w=_DD.format(t="sb"), g="select *, k - row_number() over (partition by symbol, close < peak order by ts) grp from w"), "depth")
register("WN15_worst_drawdown", lambda s, d: I.worst_drawdown(X.suppliers(s, d)).drop("recovery"),
         sql("sb", """select t.symbol, t.dd max_drawdown, min(w.ts) peak_ts, any_value(t.ts) trough_ts, any_value(t.k) - min(w.k) duration
           from t join w on w.symbol = t.symbol and w.close = t.peak and w.k <= t.k group by t.symbol, t.dd""", w=_DD.format(t="sb"),
             t="""select symbol, ts, k, peak, close / peak - 1 dd from w qualify row_number() over
             (partition by symbol order by close / peak - 1, ts) = 1"""), "max_drawdown")
register("WN16_recovery_rows", lambda s, d: I.worst_drawdown(X.suppliers(s, d)).select("symbol", "recovery"),
         sql("sb", """select t.symbol, coalesce(min(w.k) filter (w.close >= t.peak), max(w.k)) - t.k recovery
           from t join w on w.symbol = t.symbol and w.k >= t.k and (w.k > t.k or w.nx is null) group by t.symbol, t.k""", w=_DD.format(t="sb"),
             t="""select symbol, ts, k, peak from w qualify row_number() over (partition by symbol order by close / peak - 1, ts) = 1"""))
register("WN17_longest_losing_run", lambda s, d: I.longest_losing_run(X.supplier_returns(s, d)),
         sql("sr", "select symbol, coalesce(max(n) filter (f), 0) longest_losing_run from (select symbol, f, grp, count(*) n from g group by all) group by symbol",
             g="""select symbol, ret < 0 f, row_number() over (partition by symbol order by ts)
             - row_number() over (partition by symbol, ret < 0 order by ts) grp from sr"""))
register("WN19_rank_transform", lambda s, d: I.rank_transform(X.supplier_returns(s, d), "ret").select("symbol", "ts", "u"),
         sql("sr", """select symbol, ts, count(*) over (partition by symbol order by ret range between unbounded preceding and current row)
           / (count(*) over (partition by symbol) + 1.0::double) u from sr"""), {"u": 9})
register("WN21_volatility_flags", lambda s, d: I.volatility_flags(X.panel_returns(s, d)),
         sql("pr", "select ts, avg(vol) mean_vol from v group by ts having avg(vol) > (select avg(q) from l)",
             v=f"select * from (select symbol, ts, case when count(*) over {roll(20)} = 20 then stddev_samp(ret) over {roll(20)} end vol from pr) where vol is not null",
             l="select quantile_cont(vol, 0.95) q from v group by symbol"), "mean_vol")
register("WN22_ewm_covariance", lambda s, d: I.ewm_covariance(X.panel_returns(s, d)),
         sql("pr", """select sym_i, sym_j, pow(0.94::double, greatest(max(n) - 50, 0)) * covar_samp(ri, rj) filter (k <= 50)
           + coalesce(sum(0.06 * pow(0.94::double, n - k) * (ri - mid) * (rj - mid)) filter (k > 50), 0) cov from q group by 1, 2""",
             m=f"select ts, avg(m10) mid from (select ts, case when count(*) over {roll(10)} = 10 then avg(ret) over {roll(10)} end m10 from pr) group by ts",
             p=_PAIR.format(r="pr", op="<="),
             q="select p.*, mid, row_number() over (partition by sym_i, sym_j order by ts) k, count(*) over (partition by sym_i, sym_j) n from p join m using (ts)"),
         "cov")
register("WN23_rolling_beta", lambda s, d: I.rolling_beta(X.panel_returns(s, d), X.benchmark_returns(s, d)).select("symbol", "ts", "beta"),
         sql("pr br", f"""select symbol, ts, case when count(*) over r = 20 then covar_samp(ret, bench_ret) over r / var_pop(bench_ret) over r
           else 1.0 end beta from pr join br using (ts) window r as {roll(20)}"""), "beta")
register("WN24_autocorrelation", lambda s, d: I.autocorrelation(X.supplier_returns(s, d), [1, 2, 5]),
         sql("sr", "select symbol, lag, corr(ret, case lag when 1 then l1 when 2 then l2 else l5 end) rho from w, (values (1), (2), (5)) v(lag) group by all",
             w="""select symbol, ret, lag(ret, 1) over o l1, lag(ret, 2) over o l2, lag(ret, 5) over o l5 from sr
             window o as (partition by symbol order by ts)"""), "rho")
register("WN25_cusum", lambda s, d: I.cusum(X.supplier_returns(s, d)).select("symbol", "ts", "cusum"),
         sql("sr", "select symbol, ts, sum(ret - m) over (partition by symbol order by ts) cusum from w",
             w="select *, avg(ret) over (partition by symbol) m from sr"), "cusum")
register("WN26_running_mean", lambda s, d: I.running_estimate(X.supplier_returns(s, d), "ret").select("symbol", "ts", "running_mean", "recent_var"),
         sql("sr", f"select symbol, ts, m running_mean, var_pop(m) over {roll(100)} recent_var from w",
             w="select symbol, ts, avg(ret) over (partition by symbol order by ts) m from sr"), {"running_mean": 6, "recent_var": 8})
register("WN27_monthly_return", lambda s, d: I.monthly_return(X.suppliers(s, d)),
         sql("sb", "select *, last / lag(last) over (partition by symbol order by month) - 1 ret from m",
             m="select symbol, date_trunc('month', ts)::timestamp AS month, arg_max(close, ts) AS last from sb group by 1, 2"), "last:9 ret")
