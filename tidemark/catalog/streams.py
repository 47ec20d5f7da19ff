"""Streams run to completion over the event table (ST, SRC4, SRC5, UD1, UD2)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import ORACLES, register, sql
from tidemark.plans import frames as X
from tidemark.plans.session import read_table
from tidemark.streaming import ordered as O, rules as R, ticks as T


def _ticks(s, d):
    e = T.file_stream(s, d, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.col("value") + 10).alias("price"), (F.col("event_id") % 100 + 1).alias("volume"))


_CLOSED = "where e <= (select max(ts) from tk) - interval {d}"
register("ST1_tick_bars", lambda s, d: T.drain(T.tick_bars(_ticks(s, d), "10 minutes", min_ticks=2)),
         sql("tk", f"""select symbol, b "start", e "end", open, high, low, close, volume, pv / volume vwap, num_trades from (select symbol, time_bucket(interval 10 minute, ts) b, time_bucket(interval 10 minute, ts) + interval 10 minute e,
         arg_min(price, ts) open, max(price) high, min(price) low, arg_max(price, ts) AS close, sum(volume)::double volume, sum(price * volume) pv, count(*) num_trades from tk group by 1, 2, 3 having count(*) >= 2) {_CLOSED.format(d='1 minute')}"""),
         "open:9 high:9 low:9 close:9 vwap")
register("ST2_sliding_view", lambda s, d: T.drain(T.sliding_view(_ticks(s, d), "1 hour", "30 minutes")),
         sql("tk", f"""select symbol, b "start", e "end", count(*) n, avg(price) mean_price, sum(volume)::double volume from (select *, b + interval 1 hour e from (select *, unnest([time_bucket(interval 30 minute, ts),
         time_bucket(interval 30 minute, ts) - interval 30 minute]) b from tk)) {_CLOSED.format(d='1 minute')} group by 1, 2, 3"""), "mean_price")
RISK = """select symbol, ts, n::int n, case when n >= 30 then v end var_95, case when n >= 30 then sd * sqrt(252) end vol from (select symbol, ts, count(r) over w n, quantile_cont(r, 0.05) over w v, stddev_pop(r) over w sd from
  (select symbol, ts, price / lag(price) over (partition by symbol order by ts) - 1 r from tk) window w as (partition by symbol order by ts rows between 250 preceding and current row))"""
register("ST5_streaming_risk", lambda s, d: T.drain(T.stream_rule(_ticks(s, d), ["symbol"], ["ts"], R.RollingRisk(), ["symbol", "ts"])), sql("tk", RISK), "var_95 vol")
register("ST3_expiring_state", lambda s, d: T.drain(T.tick_bars(_ticks(s, d), "1 hour", "1 hour", 1)).select("symbol", "start", "num_trades"),
         sql("tk", """select symbol, b "start", count(*) num_trades from (select symbol, time_bucket(interval 1 hour, ts) b, time_bucket(interval 1 hour, ts) + interval 1 hour e from tk) """ + _CLOSED.format(d="1 hour") + " group by 1, 2"))


def _positions(s, d):
    r = read_table(s, d, "region")
    syms = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return r.select(F.col("r_regionkey").alias("portfolio"), F.posexplode(syms).alias("i", "symbol")).select(
        "portfolio", "symbol", (F.col("portfolio") * 3 + F.col("i") + 1).cast("double").alias("quantity"))


_POS = "select r_regionkey portfolio, symbol, (r_regionkey * 3 + i + 1)::double quantity from region, (values (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) t(i, symbol)"
_PR = dict(
    ps=_POS, x="select portfolio, symbol, ts, quantity * price mv from tk join ps using (symbol)",
    y="select portfolio, ts, " + ", ".join(f"last_value(case when symbol = '{n}' then mv end ignore nulls) over w m{i}" for i, n in enumerate(("click", "error", "purchase", "signup", "view"))) + " from x window w as (partition by portfolio order by ts)",
    z="select portfolio, ts, " + " + ".join(f"coalesce(m{i}, 0)" for i in range(5)) + " v, " + " + ".join(f"coalesce(m{i}, 0) * coalesce(m{i}, 0)" for i in range(5)) + " sq from y",
    u="select *, v / lag(v) over w - 1 r, max(v) over w pk, date_trunc('hour', ts) b, lead(date_trunc('hour', ts)) over w nb from z window w as (partition by portfolio order by ts)",
    q="""select *, count(r) over w n, quantile_cont(r, 0.05) over w p5, quantile_cont(r, 0.01) over w p1, stddev_pop(r) over w * sqrt(252) vol, avg(r) over w m, list(r) over w rs from u
    window w as (partition by portfolio order by ts rows between 251 preceding and current row)""",
    o="""select portfolio, strftime(b, '%Y-%m-%d %H:%M:%S') done, v AS value, p5 * v var_95, p1 * v var_99, list_avg(list_filter(rs, lambda t: t <= p5)) * v expected_shortfall, vol volatility, (pk - v) / pk drawdown,
    (m * 252 - 0.02) / vol sharpe, sq / (v * v) concentration from q where nb is not null and nb != b and n >= 10""")
_RISKS = lambda s, d: T.stream_rule(T.portfolio_ticks(_ticks(s, d), _positions(s, d), F.date_trunc("hour", "ts")), ["portfolio"], ["ts"], R.PortfolioRisk(), ["portfolio"]).where("done is not null")
_RC = "value:5 var_95:5 var_99:5 expected_shortfall:5 volatility drawdown sharpe concentration"
register("ST6_portfolio_risk", lambda s, d: T.drain(_RISKS(s, d)), sql("tk", "select * from o", **_PR), _RC)
register("ST7_risk_alerts", lambda s, d: T.drain(T.risk_alerts(_RISKS(s, d))).select("portfolio", "done", "alert"),
         sql("tk", """select portfolio, done, alert from (select portfolio, done, unnest([case when abs(var_95) > 0.05 * value then 'var_95' end, case when drawdown > 0.1 then 'drawdown' end,
         case when concentration > 0.4 then 'concentration' end, case when volatility > 0.5 then 'volatility' end]) alert from o) where alert is not null""", **_PR))


def _alerts(s, d):
    n = read_table(s, d, "nation")
    syms = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return n.select(F.col("n_nationkey").alias("alert_id"), syms[F.col("n_nationkey") % 5].alias("symbol"), (F.lit(20.0) + F.col("n_nationkey") * 12).alias("target"),
                    F.when(F.col("n_nationkey") % 3 == 0, "below").otherwise("above").alias("side"))


register("ST8_price_alerts", lambda s, d: T.drain(T.price_alerts(_ticks(s, d), _alerts(s, d))),
         sql("tk", """select alert_id, symbol, arg_min(ts, ts) ts, target, arg_min(price, ts) price from tk join (select n_nationkey alert_id, ['click', 'error', 'purchase', 'signup', 'view'][n_nationkey % 5 + 1] symbol,
         20.0::double + n_nationkey * 12 target, n_nationkey % 3 = 0 below from nation) using (symbol) where case when below then price <= target else price >= target end group by alert_id, symbol, target"""), "price:9")
register("JN13_stream_static_positions", lambda s, d: T.drain(T.portfolio_ticks(_ticks(s, d), _positions(s, d), F.date_trunc("hour", "ts"))).groupBy("portfolio", "symbol").agg(F.sum(F.col("quantity") * F.col("price")).alias("turnover")),
         sql("tk", "select portfolio, symbol, sum(quantity * price) turnover from tk join ps using (symbol) group by 1, 2", ps=_POS), "turnover:4")
register("ST9_position_metrics", lambda s, d: T.drain(T.position_metrics(_ticks(s, d), _positions(s, d))),
         sql("tk", """select portfolio, symbol, ts, quantity * price market_value, quantity * (price - coalesce(pv, price)) unrealized, abs(quantity * price) * 0.2 * 1.65 var_contribution from
         (select *, lag(price) over (partition by symbol order by ts) pv from tk) join ps using (symbol)""", ps=_POS), "market_value unrealized var_contribution")
register("ST10_trend_filter", lambda s, d: T.drain(T.stream_rule(_ticks(s, d), ["symbol"], ["ts"], R.TrendFilter(), ["symbol", "ts"])))
register("ST10_trend_filter_batch", lambda s, d: T.batch_rule(X.ticks(s, d), ["symbol"], ["ts"], R.TrendFilter(), ["symbol", "ts"]))
register("ST10_volatility_filter", lambda s, d: T.filtered_volatility(X.supplier_returns(s, d)),
         "WITH RECURSIVE " + sql("sr", "", o="select symbol, ts, row_number() over (partition by symbol order by ts) i, 0.5 * ln(greatest(ret * ret, 1e-8)) z from sr")[5:]
         + """, k AS (select symbol, 0::bigint i, null::timestamp ts, ln(0.2::double) x, 0.1::double p from (select distinct symbol from sr) union all select symbol, i, ts, px + g * (z - px), (1 - g) * (1 - g) * pp + g * g * 0.01 from
         (select *, pp / (pp + 0.01) g from (select o.symbol, o.i, o.ts, o.z, 0.99 * k.x px, 0.9801 * k.p + 0.0001 pp from k join o on o.symbol = k.symbol and o.i = k.i + 1))) select symbol, ts, exp(x) volatility from k where i > 0""", "volatility")
register("ST11_smoother", lambda s, d: T.smooth(X.hourly(s, d)))
register("ST12_adaptive_filter", lambda s, d: T.batch_rule(X.ticks(s, d), ["symbol"], ["ts"], R.TrendFilter(adapt=0.05), ["symbol", "ts"]))
register("ST13_throughput", lambda s, d: T.drain(T.throughput(_ticks(s, d), "1 hour")),
         sql("tk", "select b AS start, count(*) ticks, 0::bigint errors from (select *, time_bucket(interval 1 hour, ts) b, time_bucket(interval 1 hour, ts) + interval 1 hour e from tk) " + _CLOSED.format(d="1 minute") + " group by 1"))
register("ST14_deduplicated_ticks",
         lambda s, d: T.drain(T.dedupe_ticks(_ticks(s, d).withColumn("copy", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy"))).select("symbol", "event_id"),
         sql("tk", "select symbol, event_id from tk"))
register("ST15_user_sessions", lambda s, d: T.drain(T.sessions(T.file_stream(s, d, "events"), "user_id", "6 hours")),
         """select user_id, min(ts) "start", max(ts) + interval 6 hour AS "end", count(*) n from (select *, sum(brk) over (partition by user_id order by ts) g from (select user_id, ts,
         coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour, true)::int brk from events)) group by user_id, g having max(ts) + interval 6 hour <= (select max(ts) from events) - interval 1 hour""")


def _micro(s, d):
    """Two processors per micro-batch; one of them fails, and its batches are found whole in the reject table."""
    out = T.shared_folder(s, "micro")
    def broken(df):
        raise ValueError("processor failed")
    errors = T.process_batches(_ticks(s, d), {"counts": lambda df: df.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total")), "broken": broken}, out)
    got = s.read.parquet(f"{out}/counts").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    lost = T.rejected(s, out, "broken").groupBy("symbol").agg(F.count("*").alias("rejected"))
    return got.join(lost, "symbol").withColumn("failed", F.lit(errors["broken"] > 0))


for _n in ("ST4_micro_batch_processors", "UD2_batch_processor"):
    register(_n, _micro, sql("tk", "select symbol, count(*) n, sum(price) total, count(*) rejected, true failed from tk group by 1"), "total")


def _trade_payload(s, d):
    t = X.ticks(s, d)
    kind = F.when(F.col("event_id") % 11 == 0, "ping").otherwise("trade")
    text = F.to_json(F.struct(kind.alias("type"), F.col("symbol").alias("s"), F.unix_millis("ts").alias("t"), F.col("price").alias("p"), F.col("volume").cast("double").alias("v")))
    return t.select(F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("payload"))


register("SRC4_trade_messages", lambda s, d: T.parse_trades(_trade_payload(s, d))[0],
         sql("tk", "select symbol, date_trunc('milliseconds', ts) ts, price, volume::double volume from tk where event_id % 11 != 0 and event_id % 13 != 0"), "price:9")
register("SRC4_rejected_messages", lambda s, d: T.parse_trades(_trade_payload(s, d))[1].agg(F.count("*").alias("rejected")),
         sql("tk", "select count(*) rejected from tk where event_id % 11 = 0 or event_id % 13 = 0"))
register("SRC5_quote_payloads",
         lambda s, d: T.parse_quotes(X.ticks(s, d).select("symbol", "ts", F.to_json(F.struct(F.col("price").cast("string").alias("last_price"), F.col("volume").cast("string").alias("volume_24h"),
                                                                                    (F.col("price") - 1).alias("bid"), (F.col("price") + 1).alias("ask"))).alias("payload")), arrival=F.col("ts")),
         sql("tk", "select symbol, ts, price, volume::double volume, price - 1 bid, price + 1 ask from tk"), "price:9 bid:9 ask:9")
register("SRC13_persisted_ticks", lambda s, d: T.drain(_ticks(s, d)).select("symbol", "ts", "price"), sql("tk", "select symbol, ts, price from tk"), "price:9")



register("UD1_tick_functions",
         lambda s, d: T.drain(_ticks(s, d).select("symbol", "ts", F.explode(F.create_map(F.lit("double"), F.col("price") * 2, F.lit("root"), F.sqrt("price"))).alias("function", "result"))),
         sql("tk", "select symbol, ts, 'double' AS function, price * 2 result from tk union all select symbol, ts, 'root', sqrt(price) from tk"), "result")


# late and out-of-order ticks: the table arrives in five micro-batches, every row up to an hour late
_MARK = "(select date_trunc('millisecond', max(ts) - interval {d}) from {t})"
_TM = f"select * from tk where ts <= {_MARK.format(d='2 hours', t='tk')}"


def _late(s, d):
    x = X.ticks(s, d)
    path = O.arrivals(x, T.shared_folder(s, "late"), F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.col("event_id") * 7919, F.lit(3600)) * 1000000), 5)
    return s.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _users(s, d):
    return T.file_stream(s, d, "events").select("user_id", "ts", "event_id", (F.col("value") + 10).alias("price"))


register("ST5_late_ticks", lambda s, d: T.drain(O.ordered_rule(_late(s, d), ["symbol"], "ts", ["event_id"], R.RollingRisk(), ["symbol", "ts"], "2 hours")),
         sql("tk", RISK.replace("from tk", "from tm"), tm=_TM), "var_95 vol")
register("ST6_late_portfolio_risk",
         lambda s, d: T.drain(O.ordered_rule(_late(s, d).join(_positions(s, d), "symbol").withColumn("bucket", F.date_trunc("hour", "ts").cast("string")), ["portfolio"], "ts", ["event_id"],
                                             R.PortfolioRisk(), ["portfolio"], "2 hours").where("done is not null")),
         sql("tk", "select * from o", tm=_TM, **{k: v.replace("from tk", "from tm") for k, v in _PR.items()}), _RC)
register("ST9_late_previous_price", lambda s, d: T.drain(O.ordered_rule(_late(s, d), ["symbol"], "ts", ["event_id"], R.PreviousPrice(), ["symbol", "ts", "price"], "2 hours")),
         sql("tk", "select symbol, ts, price, lag(price) over (partition by symbol order by ts, event_id) prev from tm", tm=_TM), "price:9 prev:9")
_GAPS = "select *, sum(g) over (partition by user_id order by ts, event_id) k from (select user_id, ts, event_id, value + 10 price, (coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id), interval 0 second) > interval 1 day)::int g from events)"
register("ST3_silent_keys", lambda s, d: T.drain(O.silent_keys(_users(s, d), ["user_id"], "ts", ["event_id"], R.Activity(), "1 day", "1 hour")),
         f"""select user_id, min(ts) opened, max(ts) AS last, count(*) ticks, arg_min(price, (ts, event_id)) first_price, arg_max(price, (ts, event_id)) last_price from ({_GAPS}) group by user_id, k
         having max(ts) + interval 1 day < {_MARK.format(d='1 hour', t='events')}""", "first_price:9 last_price:9")
register("ST3_idle_restart", lambda s, d: T.drain(O.ordered_rule(_users(s, d), ["user_id"], "ts", ["event_id"], R.Activity(), ["user_id", "event_id"], "1 hour", "1 day")),
         f"select user_id, event_id, row_number() over (partition by user_id, k order by ts, event_id) seen from ({_GAPS}) where ts <= {_MARK.format(d='1 hour', t='events')}")


def _persisted(s, stream, name):
    """A stream's rows as a table of micro-batches, a retried batch written over itself."""
    out = T.shared_folder(s, "persisted")
    T.process_batches(stream, {name: lambda df: df}, out)
    return s.read.schema(stream.schema).parquet(f"{out}/{name}").select(*stream.columns)


register("SRC13_persisted_bars", lambda s, d: _persisted(s, T.tick_bars(_ticks(s, d), "10 minutes", min_ticks=2), "bars"), ORACLES["ST1_tick_bars"], "open:9 high:9 low:9 close:9 vwap")
register("SRC13_persisted_alerts", lambda s, d: _persisted(s, T.price_alerts(_ticks(s, d), _alerts(s, d)), "alerts"), ORACLES["ST8_price_alerts"], "price:9")
