"""Markov chains and regimes (MK, RG, WN20)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import register, sql
from tidemark.operators import indicators as I, markov as M, regimes as R
from tidemark.plans import frames as X
from tidemark.plans.session import read_table

SEQ = ("ts", "event_id")
CNT = lambda s, d, k=1, by=(): M.transition_counts(X.states(s, d), k, seq=SEQ, by=by)
flat = lambda df: df.withColumn("history", F.array_join("history", ">"))
_O = "(partition by entity order by ts, event_id)"
T1 = f"select * from (select entity, lag(state) over {_O} h, state nx from st) where h is not null"
P1 = "select h, nx, n, n / sum(n) over (partition by h) p from (select h, nx, count(*) n from t group by 1, 2)"
_EDGE = "(case when value < e[2] then 0 when value < e[3] then 1 when value < e[4] then 2 else 3 end)::int"
EVT = lambda s, d: read_table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), "value")
QS = f"select event_id, event_type symbol, value, {_EDGE} state from events join (select event_type, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) e from events group by 1) using (event_type)"
register("MK1_quantile_states", lambda s, d: M.quantile_states(EVT(s, d), "value", 4), QS)
register("MK1_state_moments", lambda s, d: M.state_moments(M.quantile_states(EVT(s, d), "value", 4), "value"),
         f"select symbol, state, avg(value) mean, stddev_pop(value) std, count(*) n from ({QS}) group by 1, 2", "mean std")
register("MK2_nearest_states",
         lambda s, d: M.nearest_states(EVT(s, d), M.state_moments(M.quantile_states(EVT(s, d), "value", 4), "value"), "value"),
         f"""select event_id, e.event_type symbol, e.value, c.state from events e join (select symbol, state, avg(value) mean from ({QS}) group by 1, 2) c on c.symbol = e.event_type
         qualify row_number() over (partition by event_id order by abs(e.value - c.mean), c.state) = 1""")
LI = lambda s, d: read_table(s, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), "l_extendedprice", "l_quantity")
_G = """select symbol, (p + 3 * q)::int state, l_extendedprice, l_quantity from (select l_returnflag symbol, l_extendedprice, l_quantity,
  case when l_extendedprice < a[2] then 0 when l_extendedprice < a[3] then 1 else 2 end p, case when l_quantity < b[2] then 0 when l_quantity < b[3] then 1 else 2 end q
  from lineitem join (select l_returnflag, quantile_cont(l_extendedprice, [0, 1/3.0, 2/3.0, 1]) a, quantile_cont(l_quantity, [0, 1/3.0, 2/3.0, 1]) b from lineitem group by 1) using (l_returnflag))"""
register("MK3_grid_states", lambda s, d: M.grid_states(LI(s, d), ["l_extendedprice", "l_quantity"], 3).groupBy("symbol", "state").agg(F.count("*").alias("n")),
         f"select symbol, state, count(*) n from ({_G}) group by 1, 2")
register("MK3_mahalanobis_states",
         lambda s, d: M.mahalanobis_states(M.grid_states(LI(s, d), ["l_extendedprice", "l_quantity"], 3), ["l_extendedprice", "l_quantity"]).groupBy("symbol", "state").agg(F.count("*").alias("n")),
         f"""select symbol, s.state state, count(*) n from (select x.symbol, x.l_extendedprice u, x.l_quantity v, arg_min(m.state, (m.vq * (u - m.mp) * (u - m.mp) - 2 * m.c * (u - m.mp) * (v - m.mq)
         + m.vp * (v - m.mq) * (v - m.mq)) / (m.vp * m.vq - m.c * m.c)) state from (select row_number() over () i, * from ({_G})) x join (select symbol, state, avg(l_extendedprice) mp, avg(l_quantity) mq,
         var_pop(l_extendedprice) + 1e-6 vp, var_pop(l_quantity) + 1e-6 vq, covar_pop(l_extendedprice, l_quantity) c from ({_G}) group by 1, 2) m using (symbol) group by x.i, x.symbol, u, v) s group by 1, 2""")
register("MK3_kmeans_states", lambda s, d: M.kmeans_states(LI(s, d), ["l_extendedprice", "l_quantity"], 4).groupBy("state").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("center")))
register("MK4_transition_matrix", lambda s, d: flat(M.transition_matrix(CNT(s, d))), sql("st", "select h history, nx AS next, n, p from p1", t=T1, p1=P1), "p")
register("MK4_second_order", lambda s, d: flat(M.transition_matrix(CNT(s, d, 2))),
         sql("st", "select h history, nx AS next, n, n / sum(n) over (partition by h) p from (select h, nx, count(*) n from t group by 1, 2)",
             t=f"select * from (select lag(state, 2) over {_O} || '>' || lag(state) over {_O} h, state nx from st) where h is not null"), "p")
register("MK4_per_entity_absorbing",
         lambda s, d: flat(M.transition_matrix(CNT(s, d, by=("entity",)), ("entity",), fill_absorbing=X.states(s, d).select("entity", "state").distinct())),
         sql("st", """select entity, h history, nx AS next, n, n / sum(n) over (partition by entity, h) p from (select entity, h, nx, count(*) n from t group by all)
         union all select entity, state, state, 0, 1.0 from (select distinct entity, state from st) s where not exists (select 1 from t where t.entity = s.entity and t.h = s.state)""", t=T1), "p")
_LL = "select {k} AS \"order\", sum(n * ln(p)) log_likelihood, sum(n)::bigint n_obs, -2 * sum(n * ln(p)) + ln(sum(n)) * power(5, {k} + 1) bic from (select n, n / sum(n) over (partition by h) p from (select h, nx, count(*) n from {t} group by h, nx))"
register("MK5_order_selection", lambda s, d: M.order_selection(X.states(s, d), 2, 5, seq=SEQ),
         sql("st", _LL.format(k=1, t="t") + " union all " + _LL.format(k=2, t="t2"), t=T1,
             t2=f"select * from (select lag(state, 2) over {_O} || '>' || lag(state) over {_O} h, state nx from st) where h is not null"), "log_likelihood:5 bic:5")
_IX = f"select * from (select state i, lead(state) over {_O} j, (epoch_us(lead(ts) over {_O}) - epoch_us(ts)) / 3.6e9::double dt from st) where j is not null"
_Q = """select i, j, count(*) / any_value(h) q from x join (select i, sum(dt) h from x group by i) using (i) where i != j group by i, j
  union all select i, i, -count(*) filter (i != j) / sum(dt) from x group by i"""
register("MK6_intensity_holding", lambda s, d: M.intensity(X.states(s, d), seq=SEQ), sql("st", _Q, x=_IX), "q:9")
register("MK6_intensity_moments", lambda s, d: M.intensity_moments(CNT(s, d), 0.5), sql("st", "select h i, nx j, (p - (h = nx)::int) / 0.5 q from p1", t=T1, p1=P1), "q")
register("MK7_holding_times", lambda s, d: M.holding_times(M.intensity(X.states(s, d), seq=SEQ)),
         sql("st", "select i state, -q exit_rate, -1 / q expected_holding from q where i = j", x=_IX, q=_Q), "exit_rate expected_holding")


def _start(s, d):
    last = X.states(s, d).groupBy("entity").agg(F.max_by("state", F.struct(*SEQ)).alias("state"))
    return last.withColumn("p", F.lit(1.0))


register("MK8_three_step_distribution", lambda s, d: M.step_distribution(_start(s, d), M.transition_matrix(CNT(s, d)), 3),
         sql("st", """select s.entity, c.nx state, sum(a.p * b.p * c.p) p from (select entity, arg_max(state, (ts, event_id)) state from st group by 1) s join p1 a on a.h = s.state
         join p1 b on b.h = a.nx join p1 c on c.h = b.nx group by 1, 2""", t=T1, p1=P1), "p")
_P2 = "select a, b, nx, n / sum(n) over (partition by a, b) p from (select a, b, nx, count(*) n from (select lag(state, 2) over {o} a, lag(state) over {o} b, state nx from st) where a is not null group by all)".format(o=_O)
register("MK8_second_order_forecast", lambda s, d: M.forecast(M.last_states(X.states(s, d), 2, seq=SEQ), M.transition_matrix(CNT(s, d, 2)), 3),
         sql("st", """select entity, z.nx state, sum(x.p * y.p * z.p) p from (select entity, arg_max(state, (ts, event_id)) b, arg_max(pv, (ts, event_id)) a from (select *, lag(state) over (partition by entity order by ts, event_id) pv from st) where pv is not null group by 1) s
         join p2 x on x.a = s.a and x.b = s.b join p2 y on y.a = s.b and y.b = x.nx join p2 z on z.a = x.nx and z.b = y.nx group by 1, 2""", p2=_P2), "p")
register("MK9_stationary_distribution",
         lambda s, d: M.stationary(M.transition_matrix(CNT(s, d)).withColumn("chain", F.lit("all")), ["chain"]).select("state", "pi"),
         "WITH RECURSIVE " + sql("st", "", t=T1, p1=P1)[5:] + """, w AS (select 0 step, h state, 1 / 5.0::double pi from (select distinct h from p1) union all
         select step + 1, nx, sum(pi * p) from w join p1 on h = state where step < 60 group by 1, 2) select state, pi from w where step = 60""", "pi")
register("MK9_stationary_intensity", lambda s, d: M.stationary(M.intensity(X.states(s, d), seq=SEQ).withColumn("chain", F.lit("all")), ["chain"], rates=True).select("state", "pi"),
         "WITH RECURSIVE " + sql("st", "", x=_IX, q=_Q, g="select i, j, (i = j)::int + q / (select max(abs(q)) * 1.05 from q) p from q")[5:]
         + """, w AS (select 0 step, i state, 1 / 5.0::double pi from (select distinct i from q) union all select step + 1, j, sum(pi * p) from w join g on i = state where step < 200 group by 1, 2)
         select state, pi from w where step = 200""", "pi")
register("MK10_state_correlation", lambda s, d: M.state_correlation(M.grid_states(LI(s, d), ["l_extendedprice", "l_quantity"], 3), ["l_extendedprice", "l_quantity"]),
         f"select symbol, state, corr(l_extendedprice, l_quantity) corr_l_extendedprice_l_quantity, count(*) n from ({_G}) group by 1, 2", "corr_l_extendedprice_l_quantity")
register("MK11_bayesian_intervals", lambda s, d: flat(M.interval_estimates(CNT(s, d), 5)),
         sql("st", """select history, "next", n, p, greatest(0, p - 1.959963984540054 * sd) low, least(1, p + 1.959963984540054 * sd) high from (select h history, nx AS "next", n, (n + 1) / (t + 5.0::double) p,
         sqrt((n + 1) / (t + 5.0::double) * (1 - (n + 1) / (t + 5.0::double)) / (t + 6.0::double)) sd from (select h, nx, count(*) n, sum(count(*)) over (partition by h) t from t group by 1, 2))""", t=T1), "p low high")
register("MK11_windowed_counts",
         lambda s, d: flat(M.transition_counts(X.states(s, d).withColumn("week", F.date_trunc("week", "ts")), seq=SEQ, by=("week",))),
         sql("st", "select date_trunc('week', ts)::timestamp AS week, h history, nx AS next, count(*) n from (select ts, lag(state) over (partition by entity order by ts, event_id) h, state nx from st) where h is not null group by 1, 2, 3"))

# regimes
_PW = "(partition by symbol order by ts rows between 20 preceding and 1 preceding)"
VOLZ = f"select * from (select symbol, ts, ret, lag(zz) over (partition by symbol order by ts) z from (select *, case when count(ret) over {_PW} = 20 then stddev_pop(ret) over {_PW} end zz from pr)) where z is not null"
TV = lambda s, d: R.threshold_variable(X.panel_returns(s, d))
CLS = lambda s, d: R.classify(TV(s, d), R.quantile_thresholds(TV(s, d), 3))
RG = "select symbol, ts, ret, z, ((z > a)::int + (z > b)::int)::int regime from v join (select symbol, quantile_cont(z, 1/3.0) a, quantile_cont(z, 2/3.0) b from v group by 1) using (symbol)"
register("RG1_threshold_regimes", CLS, sql("pr", "select * from rg", v=VOLZ, rg=RG), "ret z")
register("RG1_level_change", lambda s, d: R.threshold_variable(X.panel_returns(s, d), "level", 2).join(
    R.threshold_variable(X.panel_returns(s, d), "change", 2).withColumnRenamed("z", "zc").drop("ret"), ["symbol", "ts"]),
    sql("pr", "select * from (select symbol, ts, ret, lag(l, 2) over w z, lag(ret, 2) over w zc from (select *, sum(ret) over (partition by symbol order by ts) l from pr) window w as (partition by symbol order by ts)) where z is not null"),
    "ret z zc")
_LLS = "case when var_pop({f}) > 0 then -count({f}) / 2.0 * (ln(2 * pi() * var_pop({f})) + 1) else 0 end"
register("RG2_grid_threshold", lambda s, d: R.grid_threshold(TV(s, d)),
         sql("pr", "select symbol, arg_max(c, ll) threshold, max(ll) log_likelihood from g where na >= 10 and nb >= 10 group by 1", v=VOLZ,
             c="select symbol, unnest(quantile_cont(z, [" + ", ".join(f"{i / 100}" for i in range(10, 91)) + "])) c from v group by 1",
             y="select symbol, c, case when z <= c then ret end a, case when z > c then ret end b from v join c using (symbol)",
             g=f"select symbol, c, count(a) na, count(b) nb, {_LLS.format(f='a')} + {_LLS.format(f='b')} ll from y group by 1, 2"), "threshold log_likelihood:4")
PRM = "select symbol, regime, avg(ret) mean, stddev_pop(ret) std, count(*) n, count(*) / sum(count(*)) over (partition by symbol) frequency from rg group by 1, 2"
register("RG3_regime_parameters", lambda s, d: R.parameters(CLS(s, d)), sql("pr", PRM, v=VOLZ, rg=RG), "mean std frequency")
_IC = """select symbol, ll log_likelihood, n n_obs, -2 * ll + 16 aic, -2 * ll + ln(n) * 8 bic from (select symbol, sum(-n / 2.0 * (ln(2 * pi() * std * std) + 1)) ll, sum(n)::bigint n from pm group by 1)"""
register("RG4_information_criteria", lambda s, d: R.information_criteria(R.parameters(CLS(s, d)), 3), sql("pr", _IC, v=VOLZ, rg=RG, pm=PRM), "log_likelihood:4 aic:4 bic:4")


def _models(s, d):
    three = R.information_criteria(R.parameters(CLS(s, d)), 3).withColumn("model", F.lit("three"))
    two = R.information_criteria(R.parameters(R.classify(TV(s, d), R.quantile_thresholds(TV(s, d), 2))), 2).withColumn("model", F.lit("two"))
    return three.unionByName(two).select("symbol", "model", F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"))


_IC2 = _IC.replace("+ 16 aic", "+ 10 aic").replace("* 8 bic", "* 5 bic").replace("from pm", "from pm2")
_MODELS = dict(v=VOLZ, rg=RG, pm=PRM, ic=_IC, rg2="select symbol, ret, (z > a)::int regime from v join (select symbol, quantile_cont(z, 0.5) a from v group by 1) using (symbol)",
               pm2=PRM.replace("from rg", "from rg2"), ic2=_IC2,
               mo="select symbol, 'three' model, round(aic, 4) aic, round(bic, 4) bic from ic union all select symbol, 'two', round(aic, 4), round(bic, 4) from ic2")
register("WN20_model_ranking", lambda s, d: I.rank_models(_models(s, d), ["symbol"]),
         sql("pr", """select *, (rank() over (partition by symbol order by aic) + (count(*) over (partition by symbol, aic) - 1) / 2)::double aic_rank,
         (rank() over (partition by symbol order by bic) + (count(*) over (partition by symbol, bic) - 1) / 2)::double bic_rank from mo""", **_MODELS), "aic:3 bic:3")
register("TK4_best_model", lambda s, d: _models(s, d).groupBy("symbol").agg(F.min_by("model", "bic").alias("best")),
         sql("pr", "select symbol, arg_min(model, bic) best from mo group by 1", **_MODELS))
register("RG5_regime_runs", lambda s, d: R.regime_runs(CLS(s, d)),
         sql("pr", """select symbol, regime, min(ts) "start", max(ts) "end", count(*) n from (select *, row_number() over (partition by symbol order by ts)
         - row_number() over (partition by symbol, regime order by ts) g from rg) group by symbol, regime, g""", v=VOLZ, rg=RG))
register("RG5_user_state_runs", lambda s, d: R.regime_runs(X.states(s, d), ("entity",), "state", SEQ, split=None),
         sql("st", """select entity, state, min(ts) "start", max(ts) "end", count(*) n from (select *, row_number() over (partition by entity order by ts, event_id)
         - row_number() over (partition by entity, state order by ts, event_id) g from st) group by entity, state, g"""))
register("RG6_first_break",
         lambda s, d: R.segment_cusum(__import__("tidemark.plans.ordered", fromlist=["x"]).row_index(X.supplier_returns(s, d), ["symbol"], ["ts"], split=False), ["symbol"], 20),
         sql("sr", "select symbol, arg_max(k, s) break_at, max(s) stat from (select symbol, k, abs(c) / sqrt(n * v) s, n from x where k >= 20 and k < n - 20) group by 1",
             x="""select symbol, row_number() over (partition by symbol order by ts) - 1 k, sum(ret - m) over (partition by symbol order by ts) c, n, v from
             (select *, avg(ret) over w m, count(*) over w n, var_pop(ret) over w v from sr window w as (partition by symbol))"""), "stat")
register("RG6_structural_breaks", lambda s, d: R.structural_breaks(X.suppliers(s, d).select("symbol", "ts", (F.col("close") * F.col("volume")).alias("ret"))))
register("RG7_regime_summary", lambda s, d: R.regime_summary(CLS(s, d)),
         sql("pr", "select pm.*, pp persistence, 1 / (1 - pp) duration from pm join (select symbol, regime, avg((nx = regime)::int) pp from (select *, lead(regime) over (partition by symbol order by ts) nx from rg) where nx is not null group by 1, 2) using (symbol, regime)",
             v=VOLZ, rg=RG, pm=PRM), "mean std frequency persistence duration")
register("RG8_regime_names", lambda s, d: R.regime_names(R.parameters(CLS(s, d))).select("symbol", "regime", "name"),
         sql("pr", "select symbol, regime, ['Bear Market', 'Sideways Market', 'Bull Market'][row_number() over (partition by symbol order by mean)] AS name from pm", v=VOLZ, rg=RG, pm=PRM))
register("RG9_pseudo_labels", lambda s, d: R.pseudo_labels(X.hourly_returns(s, d)).select("symbol", "ts", "label"),
         sql("hr", """select symbol, ts, (case when k < 20 then 1 when v > quantile_cont(v, 0.66) over u then 0 when a > quantile_cont(a, 0.33) over u then 2 else 1 end)::int AS label from y
         window u as (partition by symbol order by ts rows between unbounded preceding and current row)""",
             y="""select symbol, ts, k, case when k >= 20 then stddev_samp(ret) over f end v, case when k >= 20 then avg(ret) over f end a from (select *, row_number() over
             (partition by symbol order by ts) - 1 k from hr) window f as (partition by symbol order by ts rows between 19 preceding and current row)"""))
FIT = lambda s, d: R.fit_switching(X.hourly_returns(s, d))
register("RG10_switching_fit", lambda s, d: FIT(s, d).select("symbol", "regime", "mean", "variance", "persistence", "log_likelihood").distinct(), None,
         "mean variance persistence log_likelihood:3")
register("RG11_most_likely_path", lambda s, d: FIT(s, d).select("symbol", "ts", "regime"))


def _obs(s, d):
    w = X.states(s, d).groupBy("entity", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("obs"))
    return w


register("RG12_hidden_state_probabilities",
         lambda s, d: R.fit_discrete(_obs(s, d), 2, ["click", "error", "purchase", "signup", "view"], 10).select("entity", "ts", "state", F.round(F.col("probs")[0], 5).alias("p0")))


def _vote(s, d):
    a = CLS(s, d).select("symbol", "ts", "regime", F.lit(1.0).alias("p"))
    b = R.pseudo_labels(X.panel_returns(s, d)).select("symbol", "ts", F.col("label").alias("regime"), F.lit(1.0).alias("p"))
    return R.vote(a, b)


register("RG13_weighted_vote", _vote,
         sql("pr", """select symbol, ts, arg_max(regime, s * 100 - regime) regime, max(s) confidence from (select symbol, ts, regime, sum(w) s from (select symbol, ts, regime, 0.6::double w from rg union all
         select symbol, ts, label, 0.4 from lb) group by 1, 2, 3) group by 1, 2""", v=VOLZ, rg=RG,
             y="""select symbol, ts, k, case when k >= 20 then stddev_samp(ret) over f end v, case when k >= 20 then avg(ret) over f end a from (select *, row_number() over
             (partition by symbol order by ts) - 1 k from pr) window f as (partition by symbol order by ts rows between 19 preceding and current row)""",
             lb="""select symbol, ts, (case when k < 20 then 1 when v > quantile_cont(v, 0.66) over u then 0 when a > quantile_cont(a, 0.33) over u then 2 else 1 end)::int AS label from y
             window u as (partition by symbol order by ts rows between unbounded preceding and current row)"""), "confidence")
