"""Filters, repairs, joins and calendars (FLT, JN, WN18)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import register, sql
from tidemark.operators import align as A, clean as C
from tidemark.plans import frames as X
from tidemark.plans.session import read_table

OHLC = "open:9 high:9 low:9 close:9 volume:0"
BAR = ("symbol", "ts", "open", "high", "low", "close", "volume")


def bars(df):
    return df.select(*BAR)


COLS = "symbol, ts, open, high, low, close, volume"
register("FLT1_date_range", lambda s, d: C.date_range(read_table(s, d, "events"), "2024-01-05", "2024-01-20").select("event_id", "ts", "value"),
         "select event_id, ts, value from events where ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
register("FLT2_drop_nonpositive", lambda s, d: bars(C.drop_nonpositive(X.dirty(s, d))),
         sql("dd", f"select {COLS} from dd where not coalesce(open <= 0 or high <= 0 or low <= 0 or close <= 0, false)"), OHLC)
register("FLT3_clip_to_range", lambda s, d: bars(C.clip_to_range(X.dirty(s, d))),
         sql("dd", f"""select * replace (case when open is not null then least(greatest(open, low), high) end AS open,
         case when close is not null then least(greatest(close, low), high) end AS close) from (select {COLS} from dd)"""), OHLC)
register("FLT4_swap_high_low", lambda s, d: bars(C.swap_high_low(X.dirty(s, d))),
         sql("dd", f"""select * replace (case when high < low then low else high end AS high,
         case when high < low then high else low end AS low) from (select {COLS} from dd)"""), OHLC)
REPAIR = f"""select * replace (case when high + open + close is not null then greatest(high, open, close) end AS high,
  case when low + open + close is not null then least(low, open, close) end AS low) from (select {COLS} from dd)"""
register("FLT5_repair_bounds", lambda s, d: bars(C.repair_bounds(X.dirty(s, d))), sql("dd", REPAIR), OHLC)
DEDUPE = f"select {COLS}, k from dd qualify row_number() over (partition by symbol, ts order by k) = 1"
register("FLT6_dedupe", lambda s, d: bars(C.dedupe(X.dirty(s, d), "k")), sql("dd", f"select {COLS} from ({DEDUPE})"), OHLC)
WU = "(partition by symbol order by ts)"
FILL = ", ".join(f"last_value({c} ignore nulls) over {WU} AS {c}" for c in ("open", "high", "low", "close"))
register("FLT7_fill_forward_zero_volume", lambda s, d: bars(C.fill_missing_zero(C.dedupe(X.dirty(s, d), "k"))),
         sql("dd", f"select symbol, ts, {FILL}, coalesce(volume, 0) volume from x", x=DEDUPE), OHLC)
register("FLT8_fill_forward_median_volume", lambda s, d: bars(C.fill_missing_median(C.dedupe(X.dirty(s, d), "k"))),
         sql("dd", f"""select * from (select symbol, ts, {FILL}, coalesce(volume::double, (select quantile_cont(volume, 0.5)
         from x y where y.symbol = x.symbol)) volume from x) where close is not null""", x=DEDUPE), OHLC)


def _cap(c):
    return (f"case when abs((r_{c} - m_{c}) / s_{c}) > 5 and r_{c} > hi_{c} then p_{c} * (1 + hi_{c}) "
            f"when abs((r_{c} - m_{c}) / s_{c}) > 5 and r_{c} < lo_{c} then p_{c} * (1 + lo_{c}) else {c} end AS {c}")


P4 = ("open", "high", "low", "close")
LAGS = "select *, " + ", ".join(f"lag({c}) over {WU} p_{c}, {c} / lag({c}) over {WU} - 1 r_{c}" for c in P4) + " from f"
STAT = "select symbol, " + ", ".join(
    f"avg(r_{c}) m_{c}, stddev_pop(r_{c}) s_{c}, quantile_cont(r_{c}, 0.01) lo_{c}, quantile_cont(r_{c}, 0.99) hi_{c}" for c in P4) + " from l group by symbol"
F7 = f"select symbol, ts, {FILL}, coalesce(volume, 0) volume from x"
CAPPED = f"select symbol, ts, {', '.join(_cap(c) for c in P4)}, volume from l join g using (symbol)"
register("FLT9_cap_outliers", lambda s, d: bars(C.cap_outliers(C.fill_missing_zero(C.dedupe(X.dirty(s, d), "k")))),
         sql("dd", CAPPED, x=DEDUPE, f=F7, l=LAGS, g=STAT), OHLC)
_ISLE = dict(
    r=f"select *, close / lag(close) over {WU} - 1 r, row_number() over {WU} i from f",
    b="select symbol, avg(r) + 3 * stddev_samp(r) hi, avg(r) - 3 * stddev_samp(r) lo from r group by symbol",
    e="select r.*, case when r > hi then 1 + hi when r < lo then 1 + lo end cap from r join b using (symbol)",
    h="select *, max(case when cap is null then i end) over (partition by symbol order by i) root from e")
ADJ = """select a.symbol, a.ts, a.open, a.high, a.low, any_value(z.close) * coalesce(product(b.cap), 1) AS close, a.volume
  from h a join h z on z.symbol = a.symbol and z.i = a.root left join h b on b.symbol = a.symbol and b.i > a.root and b.i <= a.i group by all"""
register("FLT10_cap_returns", lambda s, d: bars(C.cap_returns(C.dedupe(C.fill_missing_zero(C.dedupe(X.dirty(s, d), "k")), "k"))),
         sql("dd", ADJ, x=DEDUPE, f=F7, **_ISLE), OHLC)
register("FLT11_coerce_types",
         lambda s, d: C.coerce_types(read_table(s, d, "events").select(
             "event_id", *[F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias(c) for c in P4],
             F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_id").cast("string")).alias("volume"))),
         """select event_id, case when event_id % 7 != 0 then value end AS open, open AS high, open AS low, open AS close,
         case when event_id % 5 != 0 then event_id end AS volume from events""", "volume:0")
register("FLT12_symbol_format",
         lambda s, d: C.valid_symbols(read_table(s, d, "part").select(
             "p_partkey", F.concat(F.substring("p_type", 1, 4), F.lit("."), F.substring("p_name", 1, 1)).alias("symbol")).unionByName(
             read_table(s, d, "part").select("p_partkey", F.col("p_type").alias("symbol")))),
         """select * from (select p_partkey, substr(p_type, 1, 4) || '.' || substr(p_name, 1, 1) symbol from part union all
         select p_partkey, p_type from part) where regexp_full_match(upper(symbol), '[A-Z]{1,5}(\\.[A-Z]{1,2})?')""")
register("FLT13_finite_only",
         lambda s, d: C.finite_only(read_table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("inf")))
                                    .when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")), "value"),
         "select event_id, value from events where event_id % 3 != 0 and event_id % 4 != 0")
register("FLT14_active_owner",
         lambda s, d: read_table(s, d, "orders").where("o_orderstatus = 'O'").join(read_table(s, d, "customer").where("c_acctbal > 0"),
                      F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey"),
         "select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_custkey in (select c_custkey from customer where c_acctbal > 0)")
register("FLT15_retention",
         lambda s, d: C.retain_recent(read_table(s, d, "events"), 20, F.lit("2024-01-31").cast("timestamp")).select("event_id", "ts"),
         "select event_id, ts from events where ts >= timestamp '2024-01-31' - interval 20 day")
register("FLT16_clean_a", lambda s, d: bars(C.clean_a(X.dirty(s, d), "k")),
         sql("dd", f"""select symbol, ts, least(greatest(open, low), high) AS open, high, low, least(greatest(close, low), high) AS close, volume
         from (select * replace (case when high < low then low else high end AS high, case when high < low then high else low end AS low) from c)
         where not coalesce(least(greatest(open, low), high) <= 0 or high <= 0 or low <= 0 or least(greatest(close, low), high) <= 0, false)""",
             x=DEDUPE, f=F7, l=LAGS, g=STAT, c=CAPPED), OHLC)
register("FLT17_clean_b", lambda s, d: bars(C.clean_b(C.dedupe(X.dirty(s, d), "k"))),
         sql("dd", f"select * replace (trunc(volume)::bigint AS volume) from ({ADJ})", x=DEDUPE,
             y="select * from (" + REPAIR.replace("from dd", "from x") + ") where open > 0 and high > 0 and low > 0 and close > 0",
             f=f"""select symbol, ts, {FILL}, coalesce(volume::double, (select quantile_cont(volume, 0.5) from y z where z.symbol = y.symbol)) volume from y""",
             **_ISLE), OHLC)

# joins
register("JN1_align_complete", lambda s, d: A.align_complete(X.panel_returns(s, d)).select("symbol", "ts", "ret"),
         sql("pr", "select symbol, ts, ret from pr where ts in (select ts from pr group by ts having count(*) = (select count(distinct symbol) from pr))"), "ret")
register("JN2_align_from_end", lambda s, d: A.align_from_end(X.supplier_returns(s, d)).select("symbol", "back", "ret"),
         sql("sr", "select symbol, back, ret from x where back <= (select min(n) from (select count(*) n from sr group by symbol))",
             x="select *, row_number() over (partition by symbol order by ts desc) back from sr"), "ret")
from tidemark.operators.indicators import pair_returns  # noqa: E402

register("JN3_pair_returns", lambda s, d: pair_returns(X.panel_returns(s, d)),
         sql("pr", "select a.symbol sym_i, b.symbol sym_j, a.ts, a.ret ri, b.ret rj from pr a join pr b on a.ts = b.ts and a.symbol < b.symbol"), "ri rj")
register("JN4_with_benchmark", lambda s, d: A.with_benchmark(X.panel_returns(s, d), X.benchmark_returns(s, d)),
         sql("pr br", "select symbol, ts, ret, bench_ret from pr join br using (ts)"), "ret bench_ret")
register("JN5_portfolio_positions",
         lambda s, d: X.positions(s, d).join(read_table(s, d, "customer").select(F.col("c_custkey").alias("portfolio"), "c_mktsegment"), "portfolio"),
         sql("pos", "select pos.*, c_mktsegment from pos join customer on c_custkey = portfolio"), "avg_price:9")
register("JN6_lookup_default",
         lambda s, d: A.lookup(X.positions(s, d), read_table(s, d, "supplier").where("s_acctbal < 0").select(
             F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), (F.col("s_acctbal") / 10000).alias("shock")), "symbol", {"shock": 0.0})
         .groupBy("symbol").agg(F.sum(F.col("quantity") * F.col("avg_price") * F.col("shock")).alias("impact")),
         sql("pos", """select symbol, sum(quantity * avg_price * coalesce(s_acctbal / 10000, 0)) impact from pos left join
         (select * from supplier where s_acctbal < 0) on symbol = 'S' || s_suppkey group by symbol"""), {"impact": 3})
register("JN10_asof_buy_before_sell",
         lambda s, d: A.asof(X.trades(s, d).where("action = 'sell'").select("portfolio", "symbol", "ts", "seq", "price"),
                             X.trades(s, d).where("action = 'buy'").select("portfolio", "symbol", "ts", "seq", F.col("price").alias("bp")),
                             ["portfolio", "symbol"], F.struct("ts", F.col("bp").alias("price")), ["ts", "seq"])
         .select("portfolio", "symbol", "ts", "price", F.col("asof.ts").alias("buy_ts")),
         sql("tr", """select s.portfolio, s.symbol, s.ts, s.price, max(b.ts) buy_ts from tr s left join tr b on b.action = 'buy'
         and b.portfolio = s.portfolio and b.symbol = s.symbol and b.ts < s.ts where s.action = 'sell' group by s.portfolio, s.symbol, s.ts, s.price, s.seq"""), "price:9")
_BD = """select symbol, day::date AS day from (select symbol, unnest(generate_series(min(ts)::date::timestamp, max(ts)::date::timestamp, interval 1 day)) AS day
  from sb group by symbol) where isodow(day) <= 5"""
_MISS = "select symbol, day from bd where not exists (select 1 from sb where sb.symbol = bd.symbol and sb.ts::date = bd.day)"
register("JN11_missing_business_days", lambda s, d: A.missing_business_days(X.suppliers(s, d)).select("symbol", F.col("day").cast("timestamp").alias("day")),
         sql("sb", f"select symbol, day::timestamp AS day from ({_MISS})", bd=_BD))
register("SET2_date_difference",
         lambda s, d: A.business_days(X.suppliers(s, d)).exceptAll(A.missing_business_days(X.suppliers(s, d))).groupBy("symbol").count(),
         sql("sb", "select symbol, count(distinct ts) AS count from sb where isodow(ts) <= 5 group by symbol"))
_GAPS = """select symbol, min(day)::timestamp AS "start", max(day)::timestamp AS "end" from (select symbol, day,
  {k} - row_number() over (partition by symbol order by day) grp from ms) group by symbol, grp having max(day) - min(day) >= 2"""


def _gaps(s, d, business):
    g = A.missing_day_gaps(X.suppliers(s, d), business=business)
    return g.withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})


register("WN18_missing_day_gaps", lambda s, d: _gaps(s, d, False),
         sql("sb", _GAPS.format(k="date_diff('day', date '1970-01-05', day)"), bd=_BD, ms=_MISS))
register("WN18_business_gaps", lambda s, d: _gaps(s, d, True),
         sql("sb", _GAPS.format(k="(date_diff('day', date '1970-01-05', day) // 7 * 5 + isodow(day) - 1)"), bd=_BD, ms=_MISS))
register("JN14_portfolio_returns",
         lambda s, d: A.portfolio_returns(X.supplier_returns(s, d), X.positions(s, d).select("portfolio", "symbol", (F.col("quantity") / 1000).alias("weight")))
         .groupBy("portfolio").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd_ret")),
         sql("sr pos", """select portfolio, count(*) n, avg(r) mean_ret, stddev_samp(r) sd_ret from (select portfolio, ts, sum(quantity / 1000 * ret) r
         from pos join sr using (symbol) group by 1, 2) group by 1"""), "mean_ret sd_ret")
