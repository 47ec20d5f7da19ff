"""Path tables and simulated risk (MC, RK4, PT6, SS3, SS6)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import CTES, _NEEDS, register, sql
from tidemark.operators import aggregate as G, markov as M, paths as P, risk as R, stats as S
from tidemark.plans import frames as X
from tidemark.plans.session import materialized, read_table

N, STEPS = 40, 12


def params(s, d):
    return X.suppliers(s, d).groupBy("symbol").agg((F.max_by("close", "ts") / 10).alias("s0")).select("symbol", "s0", F.lit(0.05).alias("mu"), (0.1 + F.col("s0") / 1000).alias("sigma"))


CTES["mp"] = "select symbol, arg_max(close, ts) / 10 s0, 0.05::double mu, 0.1::double + arg_max(close, ts) / 10000 sigma from sb group by symbol"
_NEEDS["mp"] = "sb"


def zsql(key):
    h = f"md5({key})"
    def u(at):
        return f"((('0x' || substr({h}, {at}, 13))::bigint + 0.5::double) / 4503599627370496.0::double)"
    return f"(sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(14)}))"


_Z = f"select symbol, s0, mu, sigma, path_id, step, {zsql(chr(39) + '1|' + chr(39) + ' || symbol || ' + chr(39) + '|' + chr(39) + ' || path_id || ' + chr(39) + '|' + chr(39) + ' || step')} z from mp, range({N}) a(path_id), range(1, {STEPS + 1}) b(step)"
_PX = f"""select symbol, path_id, step, s0, mu, sigma, s0 * exp((mu - sigma * sigma / 2) / {STEPS} * step + sigma * sqrt(1 / {STEPS}.0::double) * sum(z) over (partition by symbol, path_id order by step)) price from zz"""
_PALL = "select symbol, path_id, step, price from px union all select symbol, path_id, 0, s0 from mp, range(%d) a(path_id)" % N
register("MC1_terminal_summary", lambda s, d: G.terminal_summary(P.terminal_prices(params(s, d), N, STEPS), "price", split=False),  # N paths a symbol
         sql("mp", """select symbol, avg(price) mean, stddev_pop(price) std, min(price) "min", max(price) "max", quantile_cont(price, 0.05) p5, quantile_cont(price, 0.25) p25, median(price) median,
         quantile_cont(price, 0.75) p75, quantile_cont(price, 0.95) p95 from px where step = %d group by symbol""" % STEPS, zz=_Z, px=_PX), "mean std min max p5 p25 median p75 p95")
register("MC1_price_paths", lambda s, d: P.price_paths(params(s, d), N, STEPS), sql("mp", "select * from pa", zz=_Z, px=_PX, pa=_PALL), "price")


def _long_stats(s, d):
    """Per-path statistics from the long path table (draws any engine can repeat)."""
    return P.price_paths(params(s, d), N, STEPS).groupBy("symbol", "path_id").agg(
        F.max_by("price", "step").alias("terminal"), F.avg("price").alias("mean"), F.exp(F.avg(F.log("price"))).alias("geo"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.min_by("price", "step").alias("s0"))


STY = [("eu_call", "european", "call", 1.0, None), ("eu_put", "european", "put", 1.05, None), ("as_call", "asian", "call", 1.0, None), ("ag_put", "asian_geo", "put", 1.0, None),
       ("uo_call", "up-and-out", "call", 1.0, 1.3), ("di_put", "down-and-in", "put", 1.0, 0.9)]


def contracts(s, d):
    rows = F.array(*[F.struct(F.lit(n).alias("contract"), F.lit(st).alias("style"), F.lit(k).alias("kind"), (F.col("s0") * m).alias("strike"),
                              (F.col("s0") * F.lit(b).cast("double")).alias("barrier"), F.lit(0.0).alias("rebate")) for n, st, k, m, b in STY])
    return params(s, d).select("symbol", F.explode(rows).alias("c")).select("symbol", "c.*")


_ST = """select symbol, path_id, arg_max(price, step) terminal, avg(price) mean, exp(avg(ln(price))) geo, max(price) high, min(price) low, arg_min(price, step) s0 from pa group by 1, 2"""
_PAY = """select symbol, contract, exp(-0.05) * avg(pay) price, exp(-0.05) * stddev_pop(pay) / sqrt(count(*)) standard_error, avg(hit::int) hit_rate from (select *, case when style like '%-out' then case when hit then 0 else plain end
  when style like '%-in' then case when hit then plain else 0 end else plain end pay from (select *, greatest(0, case when kind = 'call' then lv - s0 * m else s0 * m - lv end) plain,
  case when style like 'up%' then high >= s0 * b when style like 'down%' then low <= s0 * b end hit from (select *, case style when 'asian' then mean when 'asian_geo' then geo else terminal end lv from
  {src}, (values ('eu_call', 'european', 'call', 1.0::double, null::double), ('eu_put', 'european', 'put', 1.05, null), ('as_call', 'asian', 'call', 1.0, null), ('ag_put', 'asian_geo', 'put', 1.0, null),
  ('uo_call', 'up-and-out', 'call', 1.0, 1.3), ('di_put', 'down-and-in', 'put', 1.0, 0.9)) c(contract, style, kind, m, b)))) group by 1, 2"""
register("MC3_contract_book", lambda s, d: P.contract_values(_long_stats(s, d), contracts(s, d)),
         sql("mp", "select * from v", zz=_Z, px=_PX, pa=_PALL, st=_ST, v=_PAY.format(src="st")), "price standard_error hit_rate")
register("MC4_delta", lambda s, d: P.delta(_long_stats(s, d), contracts(s, d)),
         sql("mp", "select symbol, contract, (b.price - a.price) / (s0 * 0.01) delta from v a join w b using (symbol, contract) join mp using (symbol)", zz=_Z, px=_PX, pa=_PALL, st=_ST, v=_PAY.format(src="st"),
             w=_PAY.format(src="(select symbol, s0, terminal * 1.01::double terminal, mean * 1.01::double mean, geo * 1.01::double geo, high * 1.01::double high, low * 1.01::double low from st)")), "delta")
register("MC3_block_contract_book", lambda s, d: P.block_contract_values(params(s, d), contracts(s, d), 2000, 52))
_E = "exp(-0.03) * greatest(s0 * exp(({mu} - sigma * sigma / 2) + sigma * {z}) - s0, 0)"
register("MC5_variance_reduction", lambda s, d: P.reduction_estimators(params(s, d), 200, 0.03, 1.0, 0.08),
         sql("mp", """select *, plain_var / antithetic_var antithetic_ratio, plain_var / control_var control_ratio, plain_var / importance_var importance_ratio from (select symbol, avg(p) plain, var_pop(p) plain_var, avg((p + q) / 2) antithetic,
         var_pop((p + q) / 2) antithetic_var, covar_samp(p, k) / var_pop(k) beta, avg(p) - covar_samp(p, k) / var_pop(k) * (avg(k) - max(s0)) AS control,
         var_pop(p) + power(covar_samp(p, k) / var_pop(k), 2) * var_pop(k) - 2 * covar_samp(p, k) / var_pop(k) * covar_pop(p, k) control_var, avg(w) importance, var_pop(w) importance_var from x group by 1)""",
             z1=f"select *, {zsql(chr(39) + '1|' + chr(39) + ' || symbol || ' + chr(39) + '|' + chr(39) + ' || path_id || ' + chr(39) + '|1' + chr(39))} z from mp, range(200) a(path_id)",
             x=f"""select symbol, s0, {_E.format(mu='0.03', z='z')} p, {_E.format(mu='0.03', z='(-z)')} q, exp(-0.03) * s0 * exp((0.03 - sigma * sigma / 2) + sigma * z) k,
             {_E.format(mu='0.08', z='z')} * exp(-(0.05 / sigma) * z - power(0.05 / sigma, 2) / 2) w from z1"""),
         "plain plain_var:4 antithetic antithetic_var:4 beta control control_var:4 importance importance_var:4 antithetic_ratio control_ratio:4 importance_ratio")
register("MC6_running_batches",
         lambda s, d: S.batch_convergence(P.terminal_prices(params(s, d), N, STEPS), "price", F.floor(F.col("path_id") / 10)).select("symbol", "batch", "n", "estimate", (F.col("n") / N).alias("progress")),
         sql("mp", f"select symbol, path_id // 10 batch, (sum(count(*)) over w)::bigint n, sum(sum(price)) over w / sum(count(*)) over w estimate, sum(count(*)) over w / {N} progress from px where step = {STEPS} group by 1, 2 window w as (partition by symbol order by path_id // 10)",
             zz=_Z, px=_PX), "estimate progress")
register("MC8_theory_check",
         lambda s, d: P.terminal_prices(params(s, d), N, STEPS).groupBy("symbol").agg(F.avg("price").alias("mean"), (F.first("s0") * F.exp(F.first("mu"))).alias("theory_mean"), F.stddev_pop("price").alias("std"),
                      (F.first("s0") * F.exp(F.first("mu")) * F.sqrt(F.exp(F.first("sigma") * F.first("sigma")) - 1)).alias("theory_std")),
         sql("mp", f"select symbol, avg(price) mean, any_value(s0 * exp(mu)) theory_mean, stddev_pop(price) std, any_value(s0 * exp(mu) * sqrt(exp(sigma * sigma) - 1)) theory_std from px where step = {STEPS} group by 1", zz=_Z, px=_PX),
         "mean theory_mean std:4 theory_std:4")
_MV = lambda s, d: X.supplier_returns(s, d).groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"))
register("RK4_monte_carlo_var", lambda s, d: P.monte_carlo_var(_MV(s, d), 500),
         sql("sr", "select symbol, quantile_cont(r, 0.05) var_95, quantile_cont(r, 0.01) var_99, quantile_cont(r, 0.001) var_999 from x group by 1",
             x=f"select symbol, mean + std * {zsql(chr(39) + '1|' + chr(39) + ' || symbol || ' + chr(39) + '|' + chr(39) + ' || draw')} r from (select symbol, avg(ret) mean, stddev_pop(ret) std from sr group by 1), range(500) t(draw)"),
         "var_95 var_99 var_999")

# correlated draws: one draw per event row, three symbols
W3 = {"A": 0.5, "N": 0.3, "R": 0.2}


def _panel(s, d):
    return materialized(X.panel_returns(s, d))  # three symbols by day, read several times


def _factor(s, d, panel=None):
    return P.cholesky(G.correlation(panel or _panel(s, d)))


_CH = """select a r12, b r13, c r23, sqrt(1 - a * a) l22, (c - a * b) / sqrt(1 - a * a) l32, sqrt(1 - b * b - power((c - a * b) / sqrt(1 - a * a), 2)) l33 from (select
  max(cr) filter (i = 'A' and j = 'N') a, max(cr) filter (i = 'A' and j = 'R') b, max(cr) filter (i = 'N' and j = 'R') c from (select a.symbol i, b.symbol j, corr(a.ret, b.ret) cr from pr a join pr b on a.ts = b.ts and a.symbol < b.symbol group by 1, 2))"""
_EZ = "select event_id, e0 z0, r12 * e0 + l22 * e1 z1, r13 * e0 + l32 * e1 + l33 * e2 z2 from (select event_id, " + ", ".join(
    f"{zsql(chr(39) + '1|' + chr(39) + ' || event_id || ' + chr(39) + f'|{j}' + chr(39))} e{j}" for j in range(3)) + " from events), ch"
IDS = lambda s, d: read_table(s, d, "events").select("event_id")
register("MC2_correlated_draws",
         lambda s, d: P.correlated_normals(IDS(s, d), *_factor(s, d)).select("event_id", *[F.col("z")[i].alias(f"z{i}") for i in range(3)]),
         sql("pr", "select * from ez", ch=_CH, ez=_EZ), "z0 z1 z2")
register("MC8_correlation_recovery",
         lambda s, d: P.correlated_normals(IDS(s, d), *_factor(s, d)).agg(F.corr(F.col("z")[0], F.col("z")[1]).alias("an"), F.corr(F.col("z")[0], F.col("z")[2]).alias("ar"), F.corr(F.col("z")[1], F.col("z")[2]).alias("nr")),
         sql("pr", "select corr(z0, z1) an, corr(z0, z2) ar, corr(z1, z2) nr from ez", ch=_CH, ez=_EZ), "an ar nr")


def _sim(s, d, df=None):
    panel = _panel(s, d)
    names, f = _factor(s, d, panel)
    m = {r.symbol: r for r in panel.groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("v")).collect()}
    return names, P.simulated_returns(IDS(s, d), names, f, [m[n].m for n in names], [m[n].v for n in names], df)


def _simsql(draw=lambda z: z):
    return "select event_id, " + ", ".join(f"m{i} + v{i} * {draw(f'z{i}')} r{i}" for i in range(3)) + " from ez, (select " + ", ".join(
        f"avg(ret) filter (symbol = '{n}') m{i}, stddev_samp(ret) filter (symbol = '{n}') v{i}" for i, n in enumerate("ANR")) + " from pr)"


register("PT6_simulated_portfolio_var", lambda s, d: (lambda t: P.portfolio_var(t[1], W3, t[0]))(_sim(s, d)),
         sql("pr", " union all ".join(f"select '{n}' symbol, corr(p, r{i}) * stddev_pop(r{i}) / stddev_pop(p) marginal, {W3[n]} * corr(p, r{i}) * stddev_pop(r{i}) / stddev_pop(p) component, -quantile_cont(p, 0.05) portfolio_var from x" for i, n in enumerate("ANR")),
             ch=_CH, ez=_EZ, sm=_simsql(), x="select *, 0.5 * r0 + 0.3 * r1 + 0.2 * r2 p from sm"), "marginal component portfolio_var")
register("SS3_simulated_scenarios",
         lambda s, d: (lambda t: t[1].select("event_id", (P.portfolio_draws(t[1], W3, t[0]) * 1000).alias("pnl"), F.lit(1.0 / 3).alias("third")).drop("third"))(_sim(s, d)),
         sql("pr", "select event_id, 1000 * (0.5 * r0 + 0.3 * r1 + 0.2 * r2) pnl from sm", ch=_CH, ez=_EZ, sm=_simsql()), "pnl:5")


def _t4(z):
    from tidemark.functions.mathx import norm_cdf_sql
    u = norm_cdf_sql(z)
    return f"(sign({u} - 0.5) * 2 * sqrt(cos(acos(sqrt(4 * {u} * (1 - {u}))) / 3) / sqrt(4 * {u} * (1 - {u})) - 1))"


register("SS3_t_scenarios", lambda s, d: (lambda t: t[1].select("event_id", (P.portfolio_draws(t[1], W3, t[0]) * 1000).alias("pnl")))(_sim(s, d, 4)),
         sql("pr", "select event_id, 1000 * (0.5 * r0 + 0.3 * r1 + 0.2 * r2) pnl from sm", ch=_CH, ez=_EZ, sm=_simsql(_t4)), "pnl:3")
register("SS6_tail_scenario", lambda s, d: (lambda t: P.tail_scenario(t[1], t[0], 0.99))(_sim(s, d, 4)),
         sql("pr", " union all ".join(f"select '{n}' symbol, median(r{i}) shock from x where p <= (select quantile_cont(p, 0.01) from x)" for i, n in enumerate("ANR")), ch=_CH, ez=_EZ, sm=_simsql(_t4),
             x="select *, (r0 + r1 + r2) / 3 p from sm"), "shock:5")


def _chain(s, d):
    r = X.supplier_returns(s, d).withColumn("ret", F.col("ret") / 50)
    q = M.quantile_states(r, "ret", 4, split=False)
    c = M.transition_matrix(M.transition_counts(q, 1, ("symbol",), ("ts",), "state", by=("symbol",), split=False), ("symbol",))
    start = q.groupBy("symbol").agg(F.max_by("state", "ts").alias("state"))
    return P.chain_paths(start, c.select("symbol", F.col("history")[0].alias("i"), F.col("next").alias("j"), "p"), M.state_moments(q, "ret"), 50, 30)


register("MC7_chain_resampling", lambda s, d: R.path_risk(_chain(s, d)), None, "mean volatility")
