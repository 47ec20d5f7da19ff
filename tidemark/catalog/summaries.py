"""Aggregates, data quality, scalar functions, top-k, set operations (AG, VQ, FN, TK, SET)."""
from pyspark.sql import Window, functions as F

from tidemark.catalog.cleaning import DEDUPE
from tidemark.catalog.registry import register, sql
from tidemark.functions import mathx as M, scalar as S
from tidemark.operators import aggregate as G, clean as C, indicators as I, quality as Q
from tidemark.plans import frames as X
from tidemark.plans.ordered import quantiles
from tidemark.plans.session import read_table


def _moments(c, src, col):
    """One unpivoted block of moment formulas (bias-corrected)."""
    return f"""select symbol, '{col}' "column", avg({c}) mean, stddev_samp({c}) std, min({c})::double "min", max({c})::double "max",
      skewness({c}) skew, kurtosis({c}) kurt from {src} group by symbol"""


register("AG1_describe",
         lambda s, d: G.describe(I.simple_return(X.hourly(s, d)), ["close", "volume", "ret"]),
         sql("hb", " union all ".join(_moments(c, "w", c) for c in ("close", "volume", "ret")),
             w="select *, close / lag(close) over (partition by symbol order by ts) - 1 ret from hb"), "mean std min max skew kurt")
register("AG2_terminal_summary", lambda s, d: G.terminal_summary(X.ticks(s, d), "price"),
         sql("tk", """select symbol, avg(price) mean, stddev_pop(price) std, min(price) "min", max(price) "max", quantile_cont(price, 0.05) p5,
         quantile_cont(price, 0.25) p25, median(price) median, quantile_cont(price, 0.75) p75, quantile_cont(price, 0.95) p95 from tk group by symbol"""),
         "mean std p5 p25 median p75 p95")
MISSING = "select symbol, " + ", ".join(f"100.0 * count(*) filter ({c} is null) / count(*) {c}_pct" for c in ("ts", "open", "high", "low", "close", "volume")) + \
    ", 100.0 * count(*) filter (open is null or high is null or low is null or close is null or volume is null) / count(*) any_pct from {t} group by symbol"
register("AG3_missing_report", lambda s, d: G.missing_report(X.dirty(s, d).drop("k")), sql("dd", MISSING.format(t="dd")),
         "ts_pct open_pct high_pct low_pct close_pct volume_pct any_pct")
INTEGRITY = """select symbol, count(*) filter (open <= 0) + count(*) filter (high <= 0) + count(*) filter (low <= 0) + count(*) filter (close <= 0)
  negative_prices, count(*) filter (volume = 0) zero_volume, count(*) filter (high < low) + count(*) filter (high < open) + count(*) filter (high < close)
  + count(*) filter (low > open) + count(*) filter (low > close) price_inconsistencies from {t} group by symbol"""
register("AG4_integrity", lambda s, d: G.integrity(X.dirty(s, d)), sql("dd", INTEGRITY.format(t="dd")))
IQR = """select {t}.symbol, count(*) filter ({c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a)) {o} from {t} join (select symbol,
  quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b from {t} group by symbol) q using (symbol) group by {t}.symbol"""
register("AG5_outliers_iqr", lambda s, d: G.outliers(X.ticks(s, d), "price"), sql("tk", IQR.format(t="tk", c="price", o="n_outliers")))
register("AG5_outliers_zscore", lambda s, d: G.outliers(X.supplier_returns(s, d), "ret", "zscore", 2.5, split=False),
         sql("sr", """select sr.symbol, count(*) filter (abs((ret - m) / sd) > 2.5) n_outliers from sr join (select symbol, avg(ret) m,
         stddev_pop(ret) sd from sr group by symbol) using (symbol) group by sr.symbol"""))
register("AG5_outliers_modified_z", lambda s, d: G.outliers(X.ticks(s, d), "price", "mad", 3.5),
         sql("tk", "select symbol, count(*) filter (0.6745 * dev / mad > 3.5) n_outliers from w join (select symbol, median(dev) mad from w group by symbol) using (symbol) group by symbol",
             w="select symbol, abs(price - med) dev from tk join (select symbol, median(price) med from tk group by symbol) using (symbol)"))
PAIRS = "select a.symbol sym_i, b.symbol sym_j, {e} from {t} a join {t} b on a.ts = b.ts and a.symbol <= b.symbol group by 1, 2"
register("AG7_correlation_matrix", lambda s, d: G.correlation(X.panel_returns(s, d)),
         sql("pr", PAIRS.format(e="corr(a.ret, b.ret) corr", t="pr")), "corr")
register("AG7_correlation_matrix_wide", lambda s, d: G.correlation(X.supplier_returns(s, d).withColumn("ts", F.date_trunc("month", "ts"))
                                                                  .groupBy("symbol", "ts").agg(F.sum("ret").alias("ret"))),
         sql("sr", PAIRS.format(e="corr(a.ret, b.ret) corr", t="m"), m="select symbol, date_trunc('month', ts) ts, sum(ret) ret from sr group by 1, 2"), "corr")
register("AG8_covariance_matrix", lambda s, d: G.covariance(X.panel_returns(s, d), 252),
         sql("pr", PAIRS.format(e="covar_samp(a.ret, b.ret) * 252 cov", t="pr")), "cov")
register("AG9_mergeable_moments", lambda s, d: G.moments(X.ticks(s, d), "price"),
         sql("tk", """select symbol, count(*) n, avg(price) mean, var_samp(price) AS var, avg(power(price - m, 3)) / power(var_pop(price), 1.5) skew,
         kurtosis_pop(price) kurt, min(price) "min", max(price) "max", max(price) - min(price) "range" from tk join (select symbol, avg(price) m
         from tk group by symbol) using (symbol) group by symbol"""), "mean var skew kurt range")
register("AG10_normal_percentile", lambda s, d: G.normal_percentile(X.ticks(s, d), "price", [0.05, 0.99]),
         sql("tk", f"""select symbol, avg(price) + {M.z_value(.05)!r} * stddev_samp(price) p5, avg(price) + {M.z_value(.99)!r} * stddev_samp(price) p99
         from tk group by symbol"""), "p5 p99")
register("AG11_contingency", lambda s, d: G.contingency(read_table(s, d, "lineitem"), "l_quantity", "l_discount"),
         """select least(floor((l_quantity - a) / ((b - a) / 10)), 9)::int bx, least(floor((l_discount - c) / ((e - c) / 10)), 9)::int AS "by", count(*) n
         from lineitem, (select min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) e from lineitem) group by 1, 2""")
register("AG12_portfolio_value",
         lambda s, d: X.positions(s, d).join(X.suppliers(s, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("last")), "symbol", "left")
         .groupBy("portfolio").agg(F.sum(F.col("quantity") * F.coalesce("last", "avg_price")).alias("value")),
         sql("pos sb", """select portfolio, sum(quantity * coalesce(last, avg_price)) AS value from pos left join
         (select symbol, arg_max(close, ts) AS last from sb group by symbol) using (symbol) group by portfolio"""), "value:3")
register("AG13_portfolio_totals",
         lambda s, d: X.positions(s, d).join(X.suppliers(s, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("last")), "symbol")
         .groupBy("portfolio").agg(F.sum(F.col("quantity") * F.col("last")).alias("value"),
                                   F.sum(F.col("quantity") * (F.col("last") - F.col("avg_price"))).alias("pnl"), F.count("*").alias("positions")),
         sql("pos sb", """select portfolio, sum(quantity * last) AS value, sum(quantity * (last - avg_price)) pnl, count(*) positions from pos join
         (select symbol, arg_max(close, ts) AS last from sb group by symbol) using (symbol) group by portfolio"""), "value:3 pnl:3")


def _chunk(f):
    g = f.groupby("symbol")["price"]
    return g.agg(n="count", s="sum").reset_index()[["symbol", "n", "s"]]


register("AG14_chunk_and_combine",
         lambda s, d: G.map_chunks(X.ticks(s, d).select("symbol", "price"), _chunk, "symbol string, n long, s double",
                                   lambda o: o.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("s").alias("total"))),
         sql("tk", "select symbol, count(*) n, sum(price) total from tk group by symbol"), "total")
register("AG15_category_counts", lambda s, d: read_table(s, d, "events").groupBy("event_type").count(),
         "select event_type, count(*) AS count from events group by event_type")
register("AG16_request_log", lambda s, d: G.request_log(read_table(s, d, "events").withColumn("sec", F.col("value") / 100), F.col("event_type") != "error",
                                                        "sec", ["user_id"], 10),
         """select user_id, count(*) requests, count(*) filter (event_type = 'error') / count(*) error_rate, avg(value / 100) mean,
         count(*) * 10 / sum(value / 100) per_second, quantile_cont(value / 100, 0.5) median, quantile_cont(value / 100, 0.95) p95,
         quantile_cont(value / 100, 0.99) p99 from events group by user_id""", "error_rate mean per_second median p95 p99")
register("AG17_distributed_var", lambda s, d: G.distributed_quantile(X.supplier_returns(s, d), "ret", {"var_95": .05, "var_99": .01}, ["symbol"]),
         sql("sr", "select symbol, quantile_cont(ret, 0.05) var_95, quantile_cont(ret, 0.01) var_99 from sr group by symbol"), "var_95 var_99")
register("AG17_hot_group_quantile",
         lambda s, d: quantiles(read_table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p1": .01, "p50": .5}, split=True),
         "select l_returnflag, quantile_cont(l_extendedprice, 0.01) p1, quantile_cont(l_extendedprice, 0.5) p50 from lineitem group by 1", "p1 p50")

# data quality rules
RULE_SQL = f"""select symbol, unnest([struct_pack("rule" := 'schema', severity := 'INFO', is_valid := true, affected := 0::bigint),
  struct_pack("rule" := 'types', severity := 'INFO', is_valid := true, affected := 0::bigint),
  struct_pack("rule" := 'range', severity := case when rng > 0 then 'WARNING' else 'INFO' end, is_valid := rng = 0, affected := rng),
  struct_pack("rule" := 'consistency', severity := case when cons > 0 then 'ERROR' else 'INFO' end, is_valid := cons = 0, affected := cons),
  struct_pack("rule" := 'completeness', severity := case when noc > 0 then 'CRITICAL' when 100.0 * anyn / n > 5 then 'WARNING' else 'INFO' end,
    is_valid := noc = 0 and 100.0 * anyn / n <= 5, affected := case when noc = 0 and 100.0 * anyn / n > 5 then anyn else 0 end),
  struct_pack("rule" := 'uniqueness', severity := case when dup > 0 then 'ERROR' else 'INFO' end, is_valid := dup = 0, affected := dup)]) e from a"""
_RNG = " + ".join(f"count(*) filter ({c} < 0.01 or {c} > 1000000)" for c in ("open", "high", "low", "close")) + " + count(*) filter (volume < 0 or volume > 1e12)"
_AGGV = f"""select symbol, count(*) n, {_RNG} rng, count(*) filter (high < low) + count(*) filter (high < open) + count(*) filter (high < close)
  + count(*) filter (low > open) + count(*) filter (low > close) + count(*) filter (volume < 0) cons, count(*) filter (close is null) noc,
  count(*) filter (open is null or high is null or low is null or close is null or volume is null) anyn, count(*) - count(distinct ts) dup from dd group by symbol"""
RESULTS = 'select symbol, e."rule" "rule", e.severity severity, e.is_valid is_valid, e.affected affected from r'
register("VQ9_validation_rules", lambda s, d: Q.validate(X.dirty(s, d)), sql("dd", RESULTS, a=_AGGV, r=RULE_SQL))
for name, rule in (("VQ1_schema_rule", "schema"), ("VQ2_type_rule", "types"), ("VQ4_consistency_rule", "consistency"), ("VQ5_completeness_rule", "completeness"),
                   ("VQ6_uniqueness_rule", "uniqueness")):
    register(name, lambda s, d, rule=rule: Q.validate(X.dirty(s, d)).where(F.col("rule") == rule),
             sql("dd", RESULTS + f""" where e."rule" = '{rule}'""", a=_AGGV, r=RULE_SQL))
register("VQ3_range_rule", lambda s, d: Q.range_report(X.dirty(s, d), {"close": (10.0, 300.0), "volume": (0.0, 500.0)}),
         sql("dd", """select symbol, 'close' "column", count(*) filter (close < 10 or close > 300) violations, min(close) min_actual, max(close) max_actual
         from dd group by symbol having count(*) filter (close < 10 or close > 300) > 0 union all select symbol, 'volume', count(*) filter (volume < 0 or volume > 500),
         min(volume), max(volume) from dd group by symbol having count(*) filter (volume < 0 or volume > 500) > 0"""), "min_actual max_actual")
register("VQ7_outlier_rule", lambda s, d: Q.outlier_rule(X.dirty(s, d), ["close", "volume"]),
         sql("dd", f"""select symbol, "column", n_outliers, 100.0 * n_outliers / n pct, 100.0 * n_outliers / n > 5 exceeded from (
         select symbol, 'close' "column", n_outliers, n from c join (select symbol, count(close) n from dd group by symbol) using (symbol) union all
         select symbol, 'volume', n_outliers, n from v join (select symbol, count(volume) n from dd group by symbol) using (symbol))""",
             c=IQR.format(t="dd", c="close", o="n_outliers"), v=IQR.format(t="dd", c="volume", o="n_outliers")), "pct")
register("VQ8_custom_rule",
         lambda s, d: Q.validate(X.dirty(s, d), custom={"busy": ("WARNING", lambda df: df.groupBy("symbol").agg((F.max("volume") < 1000).alias("is_valid")))})
         .where("rule = 'busy'"),
         sql("dd", """select symbol, 'busy' "rule", case when max(volume) < 1000 then 'INFO' else 'WARNING' end severity, max(volume) < 1000 is_valid,
         0::bigint affected from dd group by symbol"""))
register("VQ9_overall", lambda s, d: Q.overall(Q.validate(X.dirty(s, d))),
         sql("dd", """select symbol, count(*) filter (not e.is_valid and e.severity in ('CRITICAL', 'ERROR')) = 0 is_valid,
         count(*) filter (not e.is_valid) failed_rules from r group by symbol""", a=_AGGV, r=RULE_SQL))
_QR = sql("dd", """select x.symbol symbol, n, any_pct missing_pct, negative_prices, zero_volume, price_inconsistencies, price_outliers, volume_outliers, return_outliers, gaps,
  greatest(0, least(100, 100 - 0.5 * any_pct - 80 * (negative_prices + price_inconsistencies) / n - 30 * (price_outliers + volume_outliers) / n - 2 * gaps)) score
  from (select symbol, count(*) n from x group by symbol) x join mi using (symbol) join ig using (symbol) join po using (symbol) join vo using (symbol)
  join ro using (symbol) join (select symbol, 0::bigint gaps from x group by symbol) using (symbol)""",
          x=DEDUPE, mi=MISSING.format(t="x"), ig=INTEGRITY.format(t="x"), po=IQR.format(t="x", c="close", o="price_outliers"),
          vo=IQR.format(t="x", c="volume", o="volume_outliers"),
          w="select symbol, close / lag(close) over (partition by symbol order by ts) - 1 ret from x", ro=IQR.format(t="w", c="ret", o="return_outliers"))
register("VQ12_quality_report", lambda s, d: Q.quality_report(C.dedupe(X.dirty(s, d), "k").drop("k")).drop("issues", "warnings", "advice"), _QR, "missing_pct score")
register("VQ10_quality_score", lambda s, d: Q.quality_report(C.dedupe(X.dirty(s, d), "k").drop("k")).select("symbol", "score"), f"select symbol, score from ({_QR})", "score")
register("VQ11_recommendations",
         lambda s, d: Q.quality_report(C.dedupe(X.dirty(s, d), "k").drop("k")).select(
             "symbol", *[F.array_join(c, "; ").alias(c) for c in ("issues", "warnings", "advice")]),
         f"""select symbol, concat_ws('; ', case when missing_pct > 20 then 'missing data' end, case when negative_prices > 0 then 'non-positive prices' end,
         case when price_inconsistencies > 0 then 'price inconsistencies' end) issues, concat_ws('; ', case when gaps > 5 then 'date gaps' end,
         case when price_outliers > 0.3 then 'price outliers' end, case when zero_volume > 0 then 'zero volume' end) warnings,
         concat_ws('; ', case when missing_pct > 5 then 'impute missing rows' end, case when return_outliers > 0 then 'review return outliers' end,
         case when gaps > 0 then 'fill date gaps' end) advice from ({_QR})""")

# scalar functions
EV = "read events"
register("FN1_math", lambda s, d: read_table(s, d, "events").select(
    "event_id", F.log(F.col("value") + 1).alias("ln"), F.exp(-F.col("value") / 100).alias("ex"), F.sqrt("value").alias("sq"),
    F.pow(F.col("value") / 100, 1.5).alias("pw"), S.clip(F.col("value"), 5, 50).alias("cl")),
    "select event_id, ln(value + 1) ln, exp(-value / 100) ex, sqrt(value) sq, pow(value / 100, 1.5) pw, least(greatest(value, 5), 50) cl from events", "ln ex sq pw cl")
register("FN2_safe_divide", lambda s, d: read_table(s, d, "events").select("event_id", S.safe_divide(F.col("value"), F.col("event_id") % 3, -1.0).alias("q")),
         "select event_id, case when event_id % 3 = 0 then -1.0 else value / (event_id % 3) end q from events", "q:9")
register("FN3_format_magnitude", lambda s, d: read_table(s, d, "orders").select("o_orderkey", S.format_magnitude(F.col("o_totalprice") * F.col("o_orderkey") * 4).alias("t")),
         """select o_orderkey, case when x >= 1e12 then printf('%.2fT', x / 1e12) when x >= 1e9 then printf('%.2fB', x / 1e9)
         when x >= 1e6 then printf('%.2fM', x / 1e6) when x >= 1e3 then printf('%.2fK', x / 1e3) else printf('%.2f', x) end t
         from (select o_orderkey, o_totalprice * o_orderkey * 4 x from orders)""")
register("FN4_config_key", lambda s, d: read_table(s, d, "part").select("p_partkey", S.config_key(["p_size", "p_brand"], "run:").alias("k"),
                                                                         F.sha2("p_name", 256).alias("sha")),
         """select p_partkey, 'run:' || md5('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') k, sha256(p_name) sha from part""")
register("FN5_normal_constant", lambda s, d: X.panel_returns(s, d).groupBy("symbol").agg((F.avg("ret") + M.z_value(0.05) * F.stddev_pop("ret")).alias("v")),
         sql("pr", f"select symbol, avg(ret) + ({M.z_value(0.05)!r}) * stddev_pop(ret) v from pr group by symbol"), "v")
register("FN6_normal_cdf_quantile",
         lambda s, d: read_table(s, d, "events").selectExpr("event_id", "value / 100 - 2 as x", "(event_id % 9973 + 1) / 9975D as p")
         .select("event_id", M.norm_cdf("x").alias("cdf"), M.norm_ppf("p").alias("ppf")),
         f"""select event_id, {M.norm_cdf_sql('x')} cdf, {M.norm_ppf_sql('p')} ppf from (select event_id, value / 100 - 2 x, (event_id % 9973 + 1) / 9975.0::double p from events)""",
         "cdf:9 ppf:9")
register("FN7_dates", lambda s, d: read_table(s, d, "orders").select(
    "o_orderkey", F.weekday("o_orderdate").alias("wd"), F.last_day("o_orderdate").cast("timestamp").alias("month_end"),
    (F.weekday("o_orderdate") < 5).alias("business"), F.date_diff(F.lit("2001-12-31").cast("date"), "o_orderdate").alias("days")),
    """select o_orderkey, (isodow(o_orderdate) - 1)::int wd, last_day(o_orderdate)::timestamp month_end, isodow(o_orderdate) <= 5 business,
    date_diff('day', o_orderdate, timestamp '2001-12-31')::int AS days from orders""")
register("FN8_strings", lambda s, d: read_table(s, d, "part").select(
    "p_partkey", F.upper("p_name").alias("u"), F.contains(F.lower("p_brand"), F.lit("#2")).alias("has"), F.split("p_name", " ")[0].alias("head"),
    F.initcap(F.replace("p_name", F.lit("red"), F.lit("blue"))).alias("title")),
    """select p_partkey, upper(p_name) u, contains(lower(p_brand), '#2') has, split_part(p_name, ' ', 1) head,
    array_to_string(list_transform(string_split(replace(p_name, 'red', 'blue'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') title from part""")
register("FN9_arrays_maps",
         lambda s, d: X.panel(s, d).groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("symbol", "close"))).alias("v")).select(
             "ts", S.zip_lookup(F.col("v.symbol"), F.col("v.close"), F.lit("A"), 0.0).alias("a"),
             F.aggregate("v.close", F.lit(0.0), lambda x, y: x + y).alias("total")),
         sql("pb", "select ts, coalesce(max(close) filter (symbol = 'A'), 0) a, sum(close) total from pb group by ts"), "a:9 total:8")
register("FN10_json", lambda s, d: read_table(s, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"),
                                                                     F.to_json(F.struct("event_id", "event_type")).alias("j")),
         """select event_id, (props::json->>'k')::int k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' j from events""")


def _quantile_bins(s, d):
    e = read_table(s, d, "events").select("event_id", "value")
    edges = e.agg(F.percentile("value", [0.0, .25, .5, .75, 1.0]).alias("edges"), F.min("value").alias("a"), F.max("value").alias("b"))
    return e.join(F.broadcast(edges)).select("event_id", S.edge_bin(F.col("value"), F.col("edges")).alias("q"),
                                             S.equal_width_bin(F.col("value"), F.col("a"), F.col("b"), 10).alias("w"))


register("FN11_binning", _quantile_bins,
         """select event_id, (case when value < q[2] then 0 when value < q[3] then 1 when value < q[4] then 2 else 3 end)::int q,
         least(floor((value - a) / ((b - a) / 10)), 9)::int w from events, (select quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) q, min(value) a, max(value) b from events)""")
register("FN12_report_numbers", lambda s, d: read_table(s, d, "supplier").select(
    "s_suppkey", F.format_number("s_acctbal", 2).alias("thousands"), S.fixed(F.col("s_acctbal") / 99, 1, "%").alias("pct")),
    "select s_suppkey, format('{:,.2f}', s_acctbal) thousands, printf('%.1f%%', s_acctbal / 99) pct from supplier")
register("FN13_radical_inverse", lambda s, d: read_table(s, d, "events").select("event_id", S.radical_inverse(F.col("event_id"), 2).alias("b2"),
                                                                                S.radical_inverse(F.col("event_id"), 3).alias("b3")),
         "select event_id, " + ", ".join("(" + " + ".join(f"(event_id // {b ** i}) % {b} / {float(b) ** (i + 1)!r}::double" for i in range(30)) + f") b{b}" for b in (2, 3)) + " from events",
         "b2:12 b3:12")

# top-k and sets
W = Window
register("TK1_latest_rows_per_portfolio",
         lambda s, d: read_table(s, d, "orders").withColumn("rn", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
         .where("rn <= 3").select("o_custkey", "o_orderkey", "rn"),
         """select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc))::int rn from orders qualify rn <= 3""")
register("TK2_paged_listing", lambda s, d: read_table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(10).select("o_orderkey", "o_orderdate"),
         "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 10 offset 20")
register("TK5_first_n", lambda s, d: read_table(s, d, "events").where("event_id < 1000").select("event_id", "value"), "select event_id, value from events where event_id < 1000")
register("TK6_latest_tick", lambda s, d: X.ticks(s, d).groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("t")).select("symbol", "t.ts", "t.price"),
         sql("tk", "select symbol, max(ts) ts, arg_max(price, ts) price from tk group by symbol"))
register("TK6_recent_ticks", lambda s, d: X.ticks(s, d).join(F.broadcast(X.ticks(s, d).agg(F.max("ts").alias("now"))))
         .where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 2 HOURS")).select("symbol", "ts", "price"),
         sql("tk", "select symbol, ts, price from tk where ts >= (select max(ts) from tk) - interval 2 hour"))
register("SET1_union", lambda s, d: X.hourly(s, d).select("symbol", "ts", "close").unionByName(X.panel(s, d).select("symbol", "ts", "close")),
         sql("hb pb", "select symbol, ts, close from hb union all select symbol, ts, close from pb"), "close:9")
register("SET3_antithetic", lambda s, d: X.hourly_returns(s, d).select("symbol", "ts", F.explode(F.array(F.col("ret"), -F.col("ret"))).alias("z")),
         sql("hr", "select symbol, ts, ret z from hr union all select symbol, ts, -ret from hr"), "z")
