"""Prediction tables, user hooks, sources (ML, UD, SRC)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import CTES, _NEEDS, register, sql
from tidemark.operators import aggregate as G, models as M
from tidemark.plans import frames as X
from tidemark.plans.ordered import over_rows
from tidemark.plans.session import read_table
from tidemark.sources import readers as RD, writers as WR
from tidemark.sources.store import market_store
from tidemark.streaming.ticks import shared_folder


def _lags(s, d):
    r = over_rows(X.supplier_returns(s, d), ("symbol",), ["ts"], 2, lambda w: {"l1": F.lag("ret").over(w), "l2": F.lag("ret", 2).over(w)}, split=False)
    return r.where("l2 is not null")


def _pred(s, d):
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("yhat")) for n, c in (("lag1", F.col("l1") * -0.4), ("lag2", F.col("l2") * -0.1), ("mean", F.lit(0.0)))])
    return _lags(s, d).select("symbol", "ts", F.col("ret").alias("y"), F.explode(models).alias("m")).select("symbol", "ts", "y", "m.*")


CTES["lg"] = "select * from (select symbol, ts, ret, lag(ret) over w l1, lag(ret, 2) over w l2 from sr window w as (partition by symbol order by ts)) where l2 is not null"
CTES["pd"] = "select symbol, ts, ret y, model, case model when 'lag1' then l1 * -0.4 when 'lag2' then l2 * -0.1 else 0.0::double end yhat from lg, (values ('lag1'), ('lag2'), ('mean')) m(model)"
_NEEDS.update({"lg": "sr", "pd": "lg"})
register("ML1_model_scores", lambda s, d: M.scores(_pred(s, d)),
         sql("pd", "select model, count(*) n, avg((y - yhat) * (y - yhat)) mse, avg(abs(y - yhat)) mae, sqrt(avg((y - yhat) * (y - yhat))) rmse, 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) r2 from pd group by 1"), "mse mae rmse r2")
FOLD = lambda: F.pmod(F.floor(F.unix_seconds("ts") / 86400), F.lit(5))
_LLG = "-count(*) / 2.0 * (ln(2 * pi() * avg((y - yhat) * (y - yhat))) + 1)"
_LLL = "-count(*) * (ln(2 * avg(abs(y - yhat))) + 1)"


def _wsql(ll):
    return dict(sc=f"select symbol, model, avg(ll) score from (select symbol, model, (epoch(ts) // 86400)::bigint % 5 f, {ll} ll from pd group by 1, 2, 3) group by 1, 2",
                wt="select symbol, model, score, exp(score - max(score) over w) / sum(exp(score - mx)) over w weight from (select *, max(score) over (partition by symbol) mx from sc) window w as (partition by symbol)")


for _n, _l in (("gaussian", _LLG), ("laplace", _LLL)):
    register(f"ML2_averaging_weights_{_n}", lambda s, d, n=_n: M.averaging_weights(_pred(s, d), FOLD(), n), sql("pd", "select * from wt", **_wsql(_l)), "score weight")
register("ML3_weighted_prediction", lambda s, d: M.combine(_pred(s, d), M.averaging_weights(_pred(s, d), FOLD())),
         sql("pd", "select symbol, ts, sum(weight * yhat) yhat, any_value(y) y, sqrt(greatest(sum(weight * yhat * yhat) - power(sum(weight * yhat), 2), 0)) between_std from pd join wt using (symbol, model) group by 1, 2", **_wsql(_LLG)),
         "yhat y between_std:5")
_RB = """WITH RECURSIVE """ + sql("pd", "", b="select symbol, model, date_trunc('month', ts)::timestamp batch, avg((y - yhat) * (y - yhat)) mse from pd group by 1, 2, 3",
                                 a="select *, avg(mse) over (partition by symbol, model order by batch rows between 9 preceding and current row) am from b",
                                 nw="select symbol, model, batch, 1 / (am + 1e-8) / sum(1 / (am + 1e-8)) over (partition by symbol, batch) new_weight, row_number() over (partition by symbol, model order by batch) i from a")[5:]
register("ML4_adaptive_weights", lambda s, d: M.adaptive_weights(_pred(s, d), F.date_trunc("month", "ts")),
         _RB + """, r AS (select symbol, model, batch, new_weight, new_weight weight, i from nw where i = 1 union all select n.symbol, n.model, n.batch, n.new_weight, 0.9 * r.weight + 0.1 * n.new_weight, n.i
         from r join nw n on n.symbol = r.symbol and n.model = r.model and n.i = r.i + 1) select symbol, model, batch, new_weight, weight from r""", "new_weight weight")
_FD = """select symbol, ts, ret, l1, (case when k < st then 0 else (k - st) // tn + 1 end)::int fold from (select *, n - 5 * (n // 6) st, n // 6 tn from (select *, row_number() over (partition by symbol order by ts) - 1 k, count(*) over (partition by symbol) n from lg))"""
_CV = """select symbol, f.fold, count(*) n, slope, intercept, avg(power(ret - intercept - slope * l1, 2)) mse from fd f join (select a.symbol, t.fold, regr_slope(ret, l1) slope, regr_intercept(ret, l1) intercept from fd a
  join (values (1), (2), (3), (4), (5)) t(fold) on a.fold < t.fold group by 1, 2) using (symbol, fold) group by all"""
register("ML5_time_ordered_folds", lambda s, d: M.cross_validate(_lags(s, d), "l1", "ret"), sql("lg", _CV, fd=_FD), "slope intercept mse")
register("ML5_score_summary", lambda s, d: M.score_summary(M.cross_validate(_lags(s, d), "l1", "ret")),
         sql("lg", "select symbol, avg(mse) mean, stddev_pop(mse) std, avg(mse) - 1.96 * stddev_pop(mse) / sqrt(5) low, avg(mse) + 1.96 * stddev_pop(mse) / sqrt(5) high from cv group by 1", fd=_FD, cv=_CV), "mean std low high")
register("ML5_rolling_scores", lambda s, d: M.rolling_scores(_lags(s, d), "l1", "ret", 60).select("symbol", "ts", "yhat", "error2"),
         sql("lg", """select symbol, ts, i + b * l1 yhat, power(ret - i - b * l1, 2) error2 from (select *, regr_slope(ret, l1) over w b, regr_intercept(ret, l1) over w i, count(*) over w n from lg
         window w as (partition by symbol order by ts rows between 60 preceding and 1 preceding)) where n = 60"""), "yhat error2")
register("ML6_stacking",
         lambda s, d: M.stack(_lags(s, d).withColumn("fold", FOLD()), {"m1": "l1", "m2": "l2"}, "ret", ["symbol"]).select("symbol", F.col("coef")[0].alias("c0"), F.col("coef")[1].alias("c1"), F.col("coef")[2].alias("c2"), "r2"),
         sql("lg", """select symbol, my - b1 * ma - b2 * mb c0, b1 c1, b2 c2, (b1 * cya + b2 * cyb) / vy r2 from (select *, (cya * vb - cyb * cab) / (va * vb - cab * cab) b1, (cyb * va - cya * cab) / (va * vb - cab * cab) b2 from
         (select symbol, avg(ret) my, avg(m1) ma, avg(m2) mb, covar_pop(ret, m1) cya, covar_pop(ret, m2) cyb, var_pop(m1) va, var_pop(m2) vb, covar_pop(m1, m2) cab, var_pop(ret) vy from p group by 1))""",
             f="select *, (epoch(ts) // 86400)::bigint % 5 fold from lg",
             co="""select a.symbol, t.fold, regr_slope(ret, l1) s1, regr_intercept(ret, l1) i1, regr_slope(ret, l2) s2, regr_intercept(ret, l2) i2 from f a join (values (0), (1), (2), (3), (4)) t(fold) on a.fold != t.fold group by 1, 2""",
             p="select symbol, ret, i1 + s1 * l1 m1, i2 + s2 * l2 m2 from f join co using (symbol, fold)"), "c0:5 c1:5 c2:5 r2")
register("ML7_permutation_importance",
         lambda s, d: M.permutation_importance(read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"),
                                               {"l_quantity": 1500.0, "l_discount": 100.0}, 0.0, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).withColumn("importance", F.col("importance") / 1e6),
         """WITH a AS (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) i, row_number() over (order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey) j from lineitem),
         b AS (select avg(power(l_extendedprice - 1500 * l_quantity - 100 * l_discount, 2)) base from a) select 'l_quantity' feature, (avg(power(x.l_extendedprice - 1500 * y.l_quantity - 100 * x.l_discount, 2)) - any_value(base)) / 1e6 importance
         from a x join a y on y.j = x.i, b union all select 'l_discount', (avg(power(x.l_extendedprice - 1500 * x.l_quantity - 100 * y.l_discount, 2)) - any_value(base)) / 1e6 from a x join a y on y.j = x.i, b""", "importance")

# user hooks
register("UD5_chunk_function", lambda s, d: G.map_chunks(X.ticks(s, d).select("symbol", "price"), lambda f: f.groupby("symbol", as_index=False).agg(m=("price", "max")), "symbol string, m double",
                                                         lambda o: o.groupBy("symbol").agg(F.max("m").alias("m"))), sql("tk", "select symbol, max(price) m from tk group by 1"))
register("UD6_path_payoff",  # a path is one day of hourly closes: at most 24 values
         lambda s, d: M.payoff(X.hourly(s, d).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "close"))).alias("v")).select("symbol", "day", F.col("v.close").alias("path")),
                               "greatest(aggregate(path, 0D, (a, x) -> a + x) / size(path) - 50, 0D)").drop("path"),
         sql("hb", "select symbol, date_trunc('day', ts)::timestamp AS day, greatest(avg(close) - 50, 0) payoff from hb group by 1, 2"), "payoff")
register("UD7_rolling_metric", lambda s, d: M.rolling_metric(X.hourly_returns(s, d), lambda a: (a * a).mean(), ["ret"], 24).select("symbol", "ts", "metric"),
         sql("hr", "select symbol, ts, m metric from (select symbol, ts, avg(ret * ret) over w m, count(*) over w n from hr window w as (partition by symbol order by ts rows between 23 preceding and current row)) where n = 24"), "metric")
register("UD4_validation_rule", lambda s, d: X.ticks(s, d).groupBy("symbol").agg((F.min("price") > 0).alias("is_valid")), sql("tk", "select symbol, min(price) > 0 is_valid from tk group by 1"))

# sources
register("SRC1_read_declared_schema", lambda s, d: RD.read_bars(s, f"{d}/events.parquet", "parquet", "event_id long, value double", ("event_id", "value")), "select event_id, value from events")


def _daily_payload(s, d):
    """One payload per symbol and month, in the daily-series shape; a month bounds the text."""
    f = lambda c: F.col(c).cast("string")
    m = F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd"), F.create_map(
        F.lit("1. open"), f("open"), F.lit("2. high"), f("high"), F.lit("3. low"), f("low"), F.lit("4. close"), f("close"), F.lit("6. volume"), f("volume")))))
    return X.panel(s, d).groupBy("symbol", F.date_trunc("month", "ts")).agg(F.to_json(F.struct(m.alias("Time Series (Daily)"))).alias("payload"))


register("SRC2_daily_series", lambda s, d: RD.daily_series(_daily_payload(s, d), "1996-01-01", "1999-12-31"),
         sql("pb", "select symbol, ts, open, high, low, close, volume from pb where ts between timestamp '1996-01-01' and timestamp '1999-12-31'"), "open:9 high:9 low:9 close:9")
register("SRC3_price_pairs",
         lambda s, d: RD.price_pairs(X.hourly(s, d).groupBy("symbol", F.date_trunc("day", "ts")).agg(F.to_json(F.struct(F.collect_list(F.array(F.unix_millis("ts").cast("double"), F.col("close"))).alias("prices"))).alias("payload"))),
         sql("hb", "select upper(symbol) symbol, ts, close AS open, close AS high, close AS low, close, 0::bigint volume from hb"), "open:9 high:9 low:9 close:9")
register("SRC6_standardize", lambda s, d: RD.standardize(X.panel(s, d).select("symbol", F.col("ts").alias("Date"), F.col("open").alias("Open"), F.col("close").alias("Adj Close"))),
         sql("pb", "select symbol, open, close adj_close, ts from pb"), "open:9 adj_close:9")
register("SRC7_first_provider",
         lambda s, d: RD.first_provider(X.suppliers(s, d).where("close > 4000").withColumn("priority", F.lit(1)).unionByName(X.suppliers(s, d).withColumn("priority", F.lit(2)))).select("symbol", "priority", "ts", "close"),
         sql("sb", "select symbol, 1 priority, ts, close from sb where close > 4000 union all select symbol, 2, ts, close from sb where symbol not in (select symbol from sb where close > 4000)"), "close:9")
register("SRC9_coin_id", lambda s, d: read_table(s, d, "part").select("p_partkey", RD.coin_id(F.when(F.col("p_partkey") % 2 == 0, "eth").otherwise(F.col("p_type"))).alias("id")),
         "select p_partkey, case when p_partkey % 2 = 0 then 'ethereum' else lower(p_type) end id from part")
register("SRC12_month_partitions", lambda s, d: WR.month_columns(X.suppliers(s, d)).groupBy("year", "month").agg(F.count("*").alias("n")),
         sql("sb", "select year(ts)::int AS year, month(ts)::int AS month, count(*) n from sb group by 1, 2"))
register("SRC14_flatten", lambda s, d: RD.flatten(read_table(s, d, "part").select("p_partkey", F.struct(F.struct("p_size", "p_brand").alias("b"), "p_type").alias("a")), "_"),
         "select p_partkey, p_size a_b_p_size, p_brand a_b_p_brand, p_type a_p_type from part")
register("SRC15_job_summary",
         lambda s, d: WR.job_summary(read_table(s, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
                                                                      (F.col("o_totalprice") / 1000).alias("seconds"), F.col("o_orderdate").alias("ts")), ["kind"]),
         "select o_orderpriority kind, count(*) jobs, count(*) filter (o_orderstatus = 'F') completed, avg(o_totalprice / 1000) mean_seconds, max(o_orderdate) last_run from orders group by 1", "mean_seconds")
register("SRC8_bulk_load", lambda s, d: RD.read_many(s, d, ["customer", "supplier", "absent"], "parquet", "c_custkey long, s_suppkey long").groupBy("symbol").agg(F.count("*").alias("n")),
         "select 'customer' symbol, count(*) n from customer union all select 'supplier', count(*) from supplier")


def _written(s, d):
    out = shared_folder(s, "results")
    WR.write_results(X.suppliers(s, d).select("symbol", "ts", "close", "volume"), out, "csv", per_symbol=True)
    return s.read.schema("ts timestamp, close double, volume long, symbol string").option("header", True).csv(out)


register("SRC10_result_files", _written, sql("sb", "select symbol, ts, close, volume from sb"), "close:9")


def _risk_rows(s, d):
    """First load, then a second load that replaces the large exposures of one year; those of other portfolios stay."""
    out = shared_folder(s, "risk")
    rows = read_table(s, d, "orders").groupBy(F.col("o_custkey").alias("portfolio"), F.year("o_orderdate").alias("calculation_date")).agg(F.sum("o_totalprice").alias("exposure"))
    WR.upsert_risk(rows, out)
    WR.upsert_risk(rows.where("calculation_date = 2000 and exposure > 200000").withColumn("exposure", F.col("exposure") * 2), out)
    return s.read.parquet(out)


register("SRC11_risk_upsert", _risk_rows,
         "select portfolio, calculation_date, case when calculation_date = 2000 and e > 200000 then 2 * e else e end exposure from (select o_custkey portfolio, year(o_orderdate)::int calculation_date, sum(o_totalprice) e from orders group by 1, 2)", "exposure:4")
register("SRC8_load_report", lambda s, d: RD.load_report(s, d, ["customer", "supplier", "absent"], "parquet", "c_custkey long, s_suppkey long").select("symbol", "status", "rows"),
         "select 'customer' symbol, 'loaded' status, count(*) AS \"rows\" from customer union all select 'supplier', 'loaded', count(*) from supplier union all select 'absent', 'absent', 0")


def _round_trip(fmt):
    """Bars written in a text format and read back through the declared schema."""
    def run(s, d):
        out = shared_folder(s, fmt)
        WR.write_results(X.suppliers(s, d), out, fmt)
        return RD.read_bars(s, out, fmt, required=("symbol", "ts", "close"))
    return run


for _f in ("csv", "json"):
    register(f"SRC1_{_f}_bars", _round_trip(_f), sql("sb", "select symbol, ts, open, high, low, close, volume from sb"), "open:9 high:9 low:9 close:9")


def _written_json(s, d):
    out = shared_folder(s, "results")
    WR.write_results(X.suppliers(s, d).select("symbol", "ts", "close", "volume"), out, "json", per_symbol=True)
    return s.read.schema("ts timestamp, close double, volume long, symbol string").json(out)


register("SRC10_json_files", _written_json, sql("sb", "select symbol, ts, close, volume from sb"), "close:9")


def _stored(s, d):
    """Two appends, a correction of one year's closes, and the other months, now in two folders each, compacted."""
    st = market_store(s, shared_folder(s, "market"))
    bars = shared_folder(s, "bars")
    X.suppliers(s, d).write.parquet(bars)  # the ticks are shuffled once, for all three loads
    rows = WR.month_columns(s.read.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume long").parquet(bars))
    st.append(rows.where("volume % 2 = 0"))
    st.append(rows.where("volume % 2 != 0"))
    st.upsert(rows.where("year = 1997").withColumn("close", F.col("close") + 1), ["symbol", "ts"])
    st.compact()
    return st


register("SRC12_month_store", lambda s, d: _stored(s, d).read().where("year = 1997 or month = 6").select("symbol", "ts", "close", "volume", "year", "month"),
         sql("sb", "select symbol, ts, close + (year(ts) = 1997)::int AS close, volume, year(ts)::int AS year, month(ts)::int AS month from sb where year(ts) = 1997 or month(ts) = 6"), "close:9")
register("SRC12_pinned_version", lambda s, d: _stored(s, d).read(2).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("close").alias("total")),
         sql("sb", "select year(ts)::int AS year, month(ts)::int AS month, count(*) n, sum(close) total from sb group by 1, 2"), "total:4")
