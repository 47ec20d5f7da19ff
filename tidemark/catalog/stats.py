"""Statistical tests, diagnostics, dependence (TS, DP)."""
from pyspark.sql import functions as F

from tidemark.catalog.markov import CNT, P1, T1, _O
from tidemark.catalog.registry import register, sql
from tidemark.functions.mathx import norm_cdf_sql, norm_ppf_sql, z_value
from tidemark.operators import dependence as D, markov as M, stats as S
from tidemark.plans import frames as X
from tidemark.plans.session import read_table

_MOM = "select symbol, count(*) n, avg(power(z, 3)) s, avg(power(z, 4)) - 3 k from (select symbol, (ret - avg(ret) over w) / stddev_pop(ret) over w z from sr window w as (partition by symbol)) group by 1"
JB = "select symbol, n, n / 6.0 * (s * s + k * k / 4) statistic, exp(-n / 12.0 * (s * s + k * k / 4)) p_value from m"
register("TS1_jarque_bera", lambda s, d: S.jarque_bera(X.supplier_returns(s, d)), sql("sr", JB, m=_MOM), "statistic p_value")
_RK = "select symbol, n, i, " + norm_cdf_sql("x") + " f from (select symbol, count(*) over w n, row_number() over (partition by symbol order by ret) i, (ret - avg(ret) over w) / {sd}(ret) over w x from sr window w as (partition by symbol))"
KS = "select symbol, max(greatest(i / n - f, f - (i - 1) / n)) statistic, max(n) n from r group by 1"
_L = "((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic)"
register("TS2_kolmogorov_smirnov", lambda s, d: S.ks_normal(X.supplier_returns(s, d), split=False),
         sql("sr", "select symbol, statistic, n, least(1, greatest(0, " + " + ".join(f"{2 * (-1) ** (k - 1)} * exp(-2 * {k * k} * {_L} * {_L})" for k in range(1, 6)) + ")) p_value from k",
             r=_RK.format(sd="stddev_pop"), k=KS), "statistic p_value")
register("TS3_anderson_darling", lambda s, d: S.anderson_darling(X.supplier_returns(s, d), split=False),
         sql("sr", "select *, statistic < critical_5 AS normal from (select symbol, n, -n - sum((2 * a.i - 1) * (ln(a.f) + ln(1 - b.f))) / n statistic, round(0.787::double / (1 + 4.0::double / n - 25.0::double / (n * n)), 3) critical_5 from r a join r b using (symbol, n) where b.i = n + 1 - a.i group by 1, 2)",
             r=_RK.format(sd="stddev_samp")), "statistic:5")
_LAGS = "select a.symbol, k, sum(a.d * b.d) c from x a join x b on a.symbol = b.symbol, range(1, {h}) t(k) where b.i = a.i - k group by 1, 2"
_XD = "select symbol, row_number() over (partition by symbol order by ts) i, ret - avg(ret) over (partition by symbol) d from sr"
register("TS4_ljung_box", lambda s, d: S.ljung_box(X.supplier_returns(s, d)),
         sql("sr", "select symbol, n, statistic, exp(-statistic / 2) * (" + " + ".join(f"power(statistic / 2, {j}) / {__import__('math').factorial(j)}::double" for j in range(10)) + ") p_value from q",
             x=_XD, y="select a.symbol, k, sum(a.d * b.d) c from (select *, unnest(generate_series(1, 20)) k from x) a join x b on a.symbol = b.symbol and b.i = a.i - k group by 1, 2",
             v="select symbol, count(*) n, sum(d * d) v from x group by 1",
             q="select symbol, n, n * (n + 2) * sum(power(c / v, 2) / (n - k)) statistic from y join v using (symbol) group by symbol, n"), "statistic p_value:8")
_DF = """select symbol, ret y, lag(ret) over w y1, ret - lag(ret) over w dy, lag(ret) over w - lag(ret, 2) over w d1 from sr window w as (partition by symbol order by ts)"""
_OLS2 = """select *, (cay * vb - cby * cab) / (va * vb - cab * cab) b1, (cby * va - cay * cab) / (va * vb - cab * cab) b2 from (select symbol, count(*) n, var_pop({y}) vy, covar_pop({y}, {a}) cay,
  covar_pop({y}, {b}) cby, var_pop({a}) va, var_pop({b}) vb, covar_pop({a}, {b}) cab from {t} where {y} is not null and {a} is not null and {b} is not null group by 1)"""
register("TS5_dickey_fuller", lambda s, d: S.dickey_fuller(X.supplier_returns(s, d)),
         sql("sr", """select symbol, n, b1 / sqrt((vy - b1 * cay - b2 * cby) * n / (n - 3) / (n * (va - cab * cab / vb))) statistic, -2.86::double critical_5,
         b1 / sqrt((vy - b1 * cay - b2 * cby) * n / (n - 3) / (n * (va - cab * cab / vb))) < -2.86 stationary from o""", x=_DF, o=_OLS2.format(y="dy", a="y1", b="d1", t="x")), "statistic")
register("TS5_kpss", lambda s, d: S.kpss(X.supplier_returns(s, d)),
         sql("sr", "select symbol, n, stat statistic, 0.463::double critical_5, stat < 0.463 stationary from (select symbol, n, ss / (n * (v + 2 * l)) stat from a join l using (symbol))",
             x=_XD, a="select symbol, count(*) n, sum(s * s) ss, sum(d * d) v from (select *, sum(d) over (partition by symbol order by i) s from x) group by 1",
             l="select a.symbol, sum((1 - k / 11.0) * a.d * b.d) l from (select *, unnest(generate_series(1, 10)) k from x) a join x b on a.symbol = b.symbol and b.i = a.i - k group by 1"), "statistic")


def _fit(s, d):
    """Actual against a lagged forecast."""
    from tidemark.plans.ordered import over_rows
    r = over_rows(X.supplier_returns(s, d), ("symbol",), ["ts"], 1, lambda w: {"fit": F.lag("ret").over(w) * -0.4}, split=False).where("fit is not null")
    return r.withColumn("e", F.col("ret") - F.col("fit"))


_FIT = "select * from (select symbol, ts, ret, -0.4 * lag(ret) over (partition by symbol order by ts) fit from sr) where fit is not null"
_E2 = "select symbol, power(ret - fit, 2) y, fit a, fit * fit b from ft"
register("TS6_breusch_pagan", lambda s, d: S.heteroscedasticity(_fit(s, d), "e", "fit"),
         sql("sr", "select symbol, count(*) n, count(*) * power(corr(y, a), 2) statistic, 3.841458820694124::double critical_5, count(*) * power(corr(y, a), 2) > 3.841458820694124 significant from e group by 1",
             ft=_FIT, e=_E2), "statistic critical_5")
register("TS6_white", lambda s, d: S.heteroscedasticity(_fit(s, d), "e", "fit", "white"),
         sql("sr", "select symbol, n, n * (b1 * cay + b2 * cby) / vy statistic, 5.991464547107979::double critical_5, n * (b1 * cay + b2 * cby) / vy > 5.991464547107979 significant from o",
             ft=_FIT, e=_E2, o=_OLS2.format(y="y", a="a", b="b", t="e")), "statistic critical_5")
_CT = """select least(floor((l_quantity - a) / ((b - a) / 10)), 9)::int bx, least(floor((l_discount - c) / ((e - c) / 10)), 9)::int by_, count(*) n
  from lineitem, (select min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) e from lineitem) group by 1, 2"""
# Whole degrees of freedom have finite sums: Poisson terms (even) or half-integer terms and a normal tail (odd) for
# chi-squared, powers of the cosine for t. Logarithms keep the terms in range.
_CHI = lambda st, df: f"""(list_sum(list_transform(range(({df})::bigint // 2 + 1), lambda j: case when ({df}) % 2 = 0 and j < ({df}) // 2 then exp(j * ln({st} / 2) - {st} / 2 - lgamma(j + 1))
  when ({df}) % 2 = 1 and j > 0 then exp((j - 0.5) * ln({st} / 2) - {st} / 2 - lgamma(j + 0.5)) else 0.0::double end)) + case when ({df}) % 2 = 1 then 2 * (1 - {norm_cdf_sql(f'sqrt({st})')}) else 0 end)"""  # noqa: E731
_T2 = lambda t, n: f"""(1 - (case when ({n}) % 2 = 1 then 2 / pi() * (atan(abs({t}) / sqrt({n})) + coalesce(list_sum(list_transform(range((({n}) - 1)::bigint // 2),
  lambda j: exp((2 * j + 1) * ln(sqrt(({n}) / (({n}) + {t} * {t}))) + lgamma(j + 1) * 2 + 2 * j * ln(2) - lgamma(2 * j + 2)) * abs({t}) / sqrt(({n}) + {t} * {t}))), 0))
  else abs({t}) / sqrt(({n}) + {t} * {t}) * list_sum(list_transform(range(({n})::bigint // 2), lambda j: exp(j * ln(({n}) / (({n}) + {t} * {t})) + lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)))) end))"""  # noqa: E731
register("TS7_independence", lambda s, d: S.independence(read_table(s, d, "lineitem"), "l_quantity", "l_discount"),
         sql("", f"select statistic, df, {_CHI('statistic', 'df')} p_value from q", t=_CT,
             q="""select sum(power(coalesce(n, 0) - r * c / t.tt, 2) / (r * c / t.tt)) statistic, (count(distinct bx) - 1) * (count(distinct by_) - 1) df from (select bx, sum(n) r from t group by 1) x
             cross join (select by_, sum(n) c from t group by 1) y cross join (select sum(n)::double tt from t) t left join t z using (bx, by_)"""), "statistic p_value")
register("TS8_ramsey_reset", lambda s, d: S.ramsey_reset(_fit(s, d), "ret", "fit"),
         sql("sr", "select symbol, n, r2, r2 / 3 / ((1 - r2) / (n - 4)) statistic from (select symbol, count(*) n, power(corr(y, p1), 2) + power(corr(y, q2), 2) + power(corr(y, q3), 2) r2 from q3 group by 1)",
             ft=_FIT, x="select symbol, ret - fit y, fit p1, fit * fit p2, fit * fit * fit p3 from ft",
             q2="select *, p2 - regr_slope(p2, p1) over w * p1 - regr_intercept(p2, p1) over w q2, p3 - regr_slope(p3, p1) over w * p1 - regr_intercept(p3, p1) over w r3 from x window w as (partition by symbol)",
             q3="select *, r3 - regr_slope(r3, q2) over w * q2 - regr_intercept(r3, q2) over w q3 from q2 window w as (partition by symbol)"), "r2 statistic:5")
for _n, _v in (("", 1.5), ("_near", 3.1)):  # the second variance is near the measured ones, so that p-values spread over (0, 1)
    register(f"TS9_moment_tests{_n}", lambda s, d, v=_v: S.moment_tests(X.supplier_returns(s, d), "ret", 0.0, v),
             sql("sr", f"""select symbol, n, t t_statistic, c chi2_statistic, {_T2('t', 'df')} t_p_value, 2 * least({_CHI('c', 'df')}, 1 - {_CHI('c', 'df')}) chi2_p_value from
             (select symbol, count(*) n, count(*) - 1 df, avg(ret) / (stddev_pop(ret) / sqrt(count(*))) t, (count(*) - 1) * var_pop(ret) / {_v} c from sr group by 1)"""), "t_statistic chi2_statistic t_p_value:9 chi2_p_value:9")
register("TS10_markov_chi_square",
         lambda s, d: S.markov_fit(CNT(s, d), M.transition_matrix(CNT(s, d)).withColumn("p", F.lit(0.2))),
         sql("st", f"select statistic, df, {_CHI('statistic', 'df')} p_value from (select sum(power(n - t / 5.0, 2) / (t / 5.0)) statistic, 20::bigint df from (select n, sum(n) over (partition by h) t from p1))",
             t=T1, p1=P1), "statistic p_value")
register("TS10_markov_property", lambda s, d: S.markov_property(CNT(s, d, 2), M.transition_matrix(CNT(s, d))),
         sql("st", """select count(*) tests, count(*) filter (abs(n - e) > 2 * sqrt(e)) violations, avg((abs(n - e) > 2 * sqrt(e))::int) violation_rate from (select c.n, ab * p e from c join p1 on p1.h = c.b and p1.nx = c.nx where c.n > 5)""",
             t=T1, p1=P1, c=f"""select *, sum(n) over (partition by a, b) ab from (select a, b, nx, count(*) n from (select lag(state, 2) over {_O} a, lag(state) over {_O} b, state nx from st) where a is not null group by 1, 2, 3)"""),
         "violation_rate")
register("TS11_test_report",
         lambda s, d: S.jarque_bera(X.supplier_returns(s, d)).select("symbol", F.lit("jarque_bera").alias("test"), "statistic").unionByName(
             S.ljung_box(X.supplier_returns(s, d)).select("symbol", F.lit("ljung_box").alias("test"), "statistic")),
         sql("sr", f"select symbol, 'jarque_bera' test, statistic from ({JB}) union all select symbol, 'ljung_box', n * (n + 2) * sum(power(c / v, 2) / (n - k)) from y join v using (symbol) group by symbol, n",
             m=_MOM, x=_XD, y="select a.symbol, k, sum(a.d * b.d) c from (select *, unnest(generate_series(1, 20)) k from x) a join x b on a.symbol = b.symbol and b.i = a.i - k group by 1, 2",
             v="select symbol, count(*) n, sum(d * d) v from x group by 1"), "statistic")
BC = lambda s, d: S.batch_convergence(X.ticks(s, d), "price", F.floor(F.col("event_id") / 100))
_BC = """select symbol, batch, n, e estimate, se standard_error, e - {z} * se low, e + {z} * se high, abs(e - e5) / abs(e5 + 1e-8) relative_change,
  coalesce(abs(e - e5) / abs(e5 + 1e-8) < 0.01 and se / abs(e + 1e-8) < 0.01, false) converged from (select *, lag(e, 4) over (partition by symbol order by batch) e5 from b)""".format(z=repr(z_value(.975)))
_BB = """select symbol, batch, n, s / n e, sqrt((q - s * s / n) / (n - 1) / n) se from (select symbol, event_id // 100 batch, (sum(count(*)) over w)::bigint n, sum(sum(price)) over w s, sum(sum(price * price)) over w q
  from tk group by 1, 2 window w as (partition by symbol order by event_id // 100))"""
register("TS12_batch_convergence", BC, sql("tk", _BC, b=_BB), "estimate standard_error low high relative_change")
register("TS12_convergence_rate", lambda s, d: S.convergence_rate(BC(s, d)),
         sql("tk", "select symbol, -regr_slope(ln(se), ln(n)) rate from b join (select symbol, max(batch) m from b group by 1) using (symbol) where batch > m - 10 group by 1", b=_BB), "rate")


def _blocks(s, d):
    pi = X.states(s, d).groupBy("state").agg(F.count("*").alias("n"))
    pi = pi.join(F.broadcast(pi.agg(F.sum("n").alias("t")))).select("state", (F.col("n") / F.col("t")).alias("pi"))
    return S.block_divergence(X.states(s, d), pi, F.floor(F.col("event_id") / 500))


register("TS13_block_divergence", _blocks,
         sql("st", """select block, sum(e * ln((e + 1e-8) / (pi + 1e-8))) kl, 0.5 * sum(abs(e - pi)) tv from (select block, pi, coalesce(n, 0) / 500 e from (select distinct event_id // 500 block from st group by 1 having count(*) = 500)
         cross join (select state, count(*) / (select count(*) from st) pi from st group by 1) left join (select event_id // 500 block, state, count(*) n from st group by 1, 2) using (block, state)) group by 1"""), "kl tv")


def _quotes(s, d):
    p = read_table(s, d, "part")
    return p.groupBy(F.col("p_brand").alias("book"), F.col("p_size").cast("double").alias("strike")).agg(
        (F.avg("p_retailprice") / 25 - F.first("p_size") * 0.8).alias("call"), (F.avg("p_retailprice") / 50).alias("put"))


_Q = "select p_brand book, p_size::double strike, avg(p_retailprice) / 25 - p_size * 0.8::double call, avg(p_retailprice) / 50 put from part group by p_brand, p_size"
register("TS14_option_checks", lambda s, d: S.option_checks(_quotes(s, d), 30.0, 0.05, 0.25),
         sql("", """select book, strike, call >= bd - 1e-6 bound_ok, greatest(bd - call, 0) bound_gap, abs(call - put - (30 - strike * exp(-0.0125))) <= 1e-6 parity_ok, abs(call - put - (30 - strike * exp(-0.0125))) parity_gap,
         coalesce(r >= l - 1e-6, true) convex_ok, coalesce(r <= l + 1e-6, true) concave_flag from (select *, greatest(0, 30 - strike * exp(-0.0125)) bd, (call - lag(call) over w) / (strike - lag(strike) over w) l,
         (lead(call) over w - call) / (lead(strike) over w - strike) r from q window w as (partition by book order by strike))""", q=_Q), "bound_gap parity_gap")
register("TS15_relation_checks",
         lambda s, d: S.relation_checks(X.supplier_returns(s, d).groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.percentile("ret", .05).alias("p5"), F.percentile("ret", .01).alias("p1")),
                                        [("ordered", "inequality", "p1 <= p5", 0.0), ("near_normal", "equality", "p5 - (m - 1.645 * sd)", 0.1), ("vol_range", "range", "sd", 1.2)], ["symbol"]),
         sql("sr", """select symbol, rule, consistent, discrepancy from (select symbol, unnest([struct_pack("rule" := 'ordered', consistent := p1 <= p5, discrepancy := case when p1 <= p5 then 0.0::double else 1.0 end),
         struct_pack("rule" := 'near_normal', consistent := abs(p5 - (m - 1.645 * sd)) <= 0.1, discrepancy := abs(p5 - (m - 1.645 * sd))),
         struct_pack("rule" := 'vol_range', consistent := sd between 0 and 1.2, discrepancy := greatest(-sd, sd - 1.2, 0))], recursive := true) from (select symbol, avg(ret) m, stddev_samp(ret) sd, quantile_cont(ret, 0.05) p5, quantile_cont(ret, 0.01) p1 from sr group by 1))"""),
         "discrepancy")
_AC = """select a.symbol, k, corr(a.ret, b.ret) rho from (select *, unnest(generate_series(1, 99)) k from x) a join x b on a.symbol = b.symbol and b.i = a.i - k group by 1, 2"""
register("TS16_chain_diagnostics", lambda s, d: S.chain_diagnostics(X.hourly_returns(s, d)).select("symbol", "n", "geweke", "effective_size", "autocorrelation_time"),
         sql("hr", """select symbol, n, geweke, effective_size, autocorrelation_time from (select symbol, max(n) n, (avg(ret) filter (i <= floor(0.1 * n)) - avg(ret) filter (i > n - floor(0.5 * n))) /
         sqrt(var_pop(ret) filter (i <= floor(0.1 * n)) / count(*) filter (i <= floor(0.1 * n)) + var_pop(ret) filter (i > n - floor(0.5 * n)) / count(*) filter (i > n - floor(0.5 * n))) geweke from x group by 1) join
         (select symbol, greatest(1, n / (2 * (1 + 2 * coalesce(sum(rho) filter (k < stop and k < least(n // 4, 100)), 0)))) effective_size, coalesce(min(k) filter (k < stop and k < least(n // 10, 50) and rho < 1 / exp(1)),
         max(k) filter (k < stop and k < least(n // 10, 50)), 1)::double autocorrelation_time from ac join (select symbol, coalesce(min(k) filter (rho <= 0), 100) stop from ac group by 1) using (symbol)
         join (select symbol, count(*) n from x group by 1) using (symbol) group by symbol, n) using (symbol)""",
             x="select symbol, ret, row_number() over (partition by symbol order by ts) i, count(*) over (partition by symbol) n from hr", ac=_AC), "geweke effective_size")

# dependence
_U = "select symbol, ts, count(*) over (partition by symbol order by ret range between unbounded preceding and current row) / (count(*) over (partition by symbol) + 1.0::double) u from pr"
_PU = "select a.symbol sym_i, b.symbol sym_j, a.u, b.u v from u a join u b on a.ts = b.ts and a.symbol < b.symbol"
_NS = f"select sym_i, sym_j, corr({norm_ppf_sql('u')}, {norm_ppf_sql('v')}) rho, count(*) n from p group by 1, 2"
register("DP1_normal_score_correlation", lambda s, d: D.normal_score_correlation(X.panel_returns(s, d)), sql("pr", "select * from ns", u=_U, p=_PU, ns=_NS), "rho")
_TAU = """select sym_i, sym_j, sum(sign(a.u - b.u) * sign(a.v - b.v)) / sqrt(sum(abs(sign(a.u - b.u))) * sum(abs(sign(a.v - b.v)))::double) tau from p a join p b using (sym_i, sym_j) where a.u < b.u or (a.u = b.u and a.v < b.v) group by 1, 2"""
register("DP2_kendall_copula_parameters", lambda s, d: D.copula_parameters(D.kendall(D.pairs_of_uniforms(X.panel_returns(s, d)))).drop("n"),
         sql("pr", "select sym_i, sym_j, tau, greatest(case when tau > 0 then 2 * tau / (1 - tau) else 0.1 end, 0.01) clayton, greatest(case when tau > 0 then 1 / (1 - tau) else 1.1 end, 1.01) gumbel from ta", u=_U, p=_PU, ta=_TAU),
         "tau clayton gumbel")
register("DP3_tail_dependence", lambda s, d: D.tail_dependence(D.pairs_of_uniforms(X.panel_returns(s, d))),
         sql("pr", "select sym_i, sym_j, coalesce(avg(x) filter (side = 1), 0) upper, coalesce(avg(x) filter (side = 0), 0) lower from t group by 1, 2", u=_U, p=_PU,
             t="""select sym_i, sym_j, 1 side, k, count(*) filter (v > 0.9::double + 0.01::double * k) / count(*) x from p, range(10) r(k) where u > 0.9::double + 0.01::double * k group by 1, 2, 4 union all
             select sym_i, sym_j, 0, k, count(*) filter (v <= 0.01::double + 0.01::double * k) / count(*) from p, range(10) r(k) where u <= 0.01::double + 0.01::double * k group by 1, 2, 4"""), "upper lower")
_CL = "ln(1 + cl) - (1 + cl) * (ln(u) + ln(v)) - (2 + 1 / cl) * ln(power(u, -cl) + power(v, -cl) - 1)"
_A = "(power(-ln(u), gu) + power(-ln(v), gu))"
_GU = f"-power({_A}, 1 / gu) + (gu - 1) * (ln(-ln(u)) + ln(-ln(v))) + (1 / gu - 2) * ln({_A}) + ln(power({_A}, 1 / gu) + gu - 1) - ln(u) - ln(v)"
_GA = "-0.5 * (ln(1 - rho * rho) + (rho * rho * (a * a + b * b) - 2 * rho * a * b) / (1 - rho * rho))"
register("DP4_family_selection", lambda s, d: D.family_selection(X.panel_returns(s, d)),
         sql("pr", """select sym_i, sym_j, n, family, ll log_likelihood, 2 - 2 * ll aic, ln(n) - 2 * ll bic, ll = max(ll) over (partition by sym_i, sym_j) best from (
         select sym_i, sym_j, n, unnest(['gaussian', 'clayton', 'gumbel']) family, unnest([g, c, m]) ll from l)""", u=_U, p=_PU, ta=_TAU, ns=_NS,
             x=f"""select p.*, {norm_ppf_sql('u')} a, {norm_ppf_sql('v')} b, rho, greatest(case when tau > 0 then 2 * tau / (1 - tau) else 0.1 end, 0.01)::double cl,
             greatest(case when tau > 0 then 1 / (1 - tau) else 1.1 end, 1.01)::double gu from p join ta using (sym_i, sym_j) join ns using (sym_i, sym_j)""",
             l=f"select sym_i, sym_j, count(*) n, sum({_GA}) g, sum({_CL}) c, sum({_GU}) m from x group by 1, 2"), "log_likelihood:4 aic:4 bic:4")
