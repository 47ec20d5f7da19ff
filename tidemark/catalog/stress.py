"""Stress, ESG and crypto queries (SS, EG, CR, JN7-JN9, JN12, TK3)."""
from pyspark.sql import functions as F

from tidemark.catalog.registry import CTES, _NEEDS, register, sql
from tidemark.catalog.risk import _EV, _cov3, _grid
from tidemark.functions.mathx import z_value
from tidemark.operators import crypto as K, esg as E, portfolio as P, stress as S
from tidemark.plans import frames as X
from tidemark.plans.session import read_table

KINDS, TRADES = ["stock", "bond", "gold", "reit", "hedge", "emerging_markets"], ["tech", "bank", "oil", "pharma", "retail"]
LIMITS = {"max_drawdown": 0.2, "var_limit": 0.5, "liquidity_minimum": 0.1}


def _assets(s, d):
    """Portfolio = nation; asset names are built from the columns of all customers; weights by the size of the balance, owed or held."""
    c = read_table(s, d, "customer")
    name = F.concat_ws("_", F.array(*[F.lit(k) for k in KINDS])[(F.col("c_custkey") % 6).cast("int")],
                       F.array(*[F.lit(k) for k in TRADES])[(F.col("c_custkey") % 5).cast("int")], F.lower("c_mktsegment"))
    p = c.groupBy(F.col("c_nationkey").alias("portfolio"), name.alias("asset")).agg(F.sum(F.abs("c_acctbal")).alias("value"))
    t = p.groupBy("portfolio").agg(F.sum("value").alias("total_value"))
    return p.join(t, "portfolio").select("portfolio", "asset", (F.col("value") / F.col("total_value")).alias("weight"), "total_value")


def _book(s):
    return S.scenario_book(s).unionByName(S.regulatory_scenarios(s))


def _plain_book():
    """The scenario book in plain arithmetic, for the SQL side."""
    rows = []
    for sev, (lvl, m) in S.SEVERITY.items():
        for n, c in S.CRISES.items():
            eq, liq, vol = c["equity"], c.get("liquidity", .3), c.get("vol", 2.0)
            rows.append((f"historical_{n}_{sev.lower()}", "market_crash", int(c["days"] * (.5 + .5 * m)), c["pattern"],
                         [("equity", eq * m), ("bonds", c["bond"] * m), ("commodities", c.get("oil", -.1) * m), ("real_estate", eq * .7 * m), ("alternatives", eq * .5 * m)],
                         (vol + vol * .6 + vol * 1.2 + vol * .8) * m / 4, [("equity", liq * m), ("corporate_bonds", liq * 1.5 * m), ("alternatives", liq * 2 * m)]))
        f = .5 + (lvl - 1) * .5
        for n, (sh, (lo, hi), p) in S.GEOPOLITICAL.items():
            rows.append((f"geopolitical_{n}_{sev.lower()}", "geopolitical_event", int(lo + (hi - lo) * (lvl - 1) / 3), p, [(k, v * f) for k, v in sh.items()],
                         (1.5 + lvl * .3) * 1.0, [("emerging_markets", .4 * f), ("developed_markets", .1 * f), ("commodities", .2 * f)]))
        li = [(k, v * lvl / 2) for k, v in S.LIQUIDITY.items()]
        rows.append((f"liquidity_crisis_bank_run_{sev.lower()}", "liquidity_crisis", S.LIQUIDITY_DAYS[sev], "V" if lvl <= 2 else "U", [(k, -.5 * v) for k, v in li],
                     sum((2 + lvl * .5) * (1 + v) for _, v in li) / len(li), li))
    for n, r in S.REGULATORY.items():
        rows.append((n, "market_crash", r["days"], r["pattern"], list(r["shocks"].items()), sum(r["vols"].values()) / len(r["vols"]), list(r["liquidity"].items())))
    return rows


_B = _plain_book()


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"({x!r})::double" if isinstance(x, float) else repr(x) for x in r) + ")" for r in rows)


def _lst(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


CTES["az"] = f"""select c_nationkey portfolio, {_lst(KINDS)}[c_custkey % 6 + 1] || '_' || {_lst(TRADES)}[c_custkey % 5 + 1] || '_' || lower(c_mktsegment) asset,
  sum(abs(c_acctbal)) AS value from customer group by 1, 2"""
CTES["aw"] = "select portfolio, asset, value / sum(value) over (partition by portfolio) weight, sum(value) over (partition by portfolio) total_value from az"
CTES["bk"] = f"select * from (values {_values([(r[0], r[1], r[2], r[3], float(r[5])) for r in _B])}) t(scenario, stress_type, duration_days, pattern, vol_spike)"
CTES["sh"] = f"select * from (values {_values([(r[0], i, k, float(v)) for r in _B for i, (k, v) in enumerate(r[4])])}) t(scenario, pos, key, shock)"
CTES["lq"] = f"select * from (values {_values([(r[0], i, k, float(v)) for r in _B for i, (k, v) in enumerate(r[6])])}) t(scenario, pos, key, impact)"
_CLS = " or ".join("((" + " or ".join(f"contains(asset, '{k}')" for k in kws) + f") and (contains(lower(key), '{c}') or contains('{c}', lower(key))))" for c, kws in S.CLASSES.items())
CTES["am"] = f"""select asset, scenario, coalesce(max(shock) filter (key = asset), arg_min(shock, pos) filter (({_CLS}) or
  len(list_filter(string_split(asset, '_'), lambda t: contains(lower(key), t))) > 0), """ + ", ".join(
    f"max(shock) filter (key = '{k}')" for k in S.DEFAULT_KEYS) + ", 0) shock from (select distinct asset from az) cross join sh group by 1, 2"
CTES["al"] = """select asset, scenario, coalesce(arg_min(impact, pos) filter (contains(lower(key), asset) or contains(asset, lower(key))), 0) liquidity_impact
  from (select distinct asset from az) cross join lq group by 1, 2"""
_PF = "case pattern when 'V' then {V} when 'U' then {U} when 'L' then {L} when 'W' then {W} else 1.0 end"
CTES["sx"] = f"""select portfolio, scenario, stress_type, pattern, duration_days, vol_spike, portfolio_return, total_value, portfolio_return * total_value pnl,
  abs(portfolio_return) * {_PF.format(**S.DRAWDOWN_FACTOR)} drawdown, {z_value(.05)!r} * abs(portfolio_return) * 2 * vol_spike var_stressed, total_value * liq liquidity_shortfall,
  floor(duration_days * case stress_type when 'liquidity_crisis' then 0.5 when 'geopolitical_event' then 1.5 else 1.0 end * {_PF.format(**S.RECOVERY_FACTOR)})::int recovery_days
  from (select portfolio, scenario, sum(weight * shock) portfolio_return, sum(weight * liquidity_impact) liq, max(total_value) total_value from aw join am using (asset)
  join al using (asset, scenario) group by 1, 2) join bk using (scenario)"""
CTES["sb2"] = """select *, drawdown > 0.2 drawdown_breach, abs(var_stressed) > 0.5 var_breach, liquidity_shortfall > 0.1 * total_value liquidity_breach,
  greatest(0, 0.12 - abs(portfolio_return)) capital_ratio, (greatest(0, 0.12 - abs(portfolio_return)) - 0.08) * total_value capital_surplus,
  case when abs(portfolio_return) < 1 then 1 / (1 + abs(portfolio_return)) else 0 end leverage from sx"""
_NEEDS.update({"aw": "az", "am": "az sh", "al": "az lq", "sx": "aw am al bk", "sb2": "sx"})
RUN = lambda s, d: S.run_scenarios(_assets(s, d), _book(s), LIMITS)

register("JN8_asset_shock_match", lambda s, d: S.asset_shocks(_assets(s, d), _book(s)).select("asset", "scenario", "shock"), sql("am", "select * from am"), "shock:9")
register("JN9_liquidity_match", lambda s, d: S.asset_shocks(_assets(s, d), _book(s)).select("asset", "scenario", "liquidity_impact"), sql("al", "select * from al"), "liquidity_impact:9")
register("JN7_scenario_positions",
         lambda s, d: __import__("tidemark.operators.align", fromlist=["x"]).scenario_positions(_assets(s, d), _book(s)).groupBy("portfolio", "scenario").agg(F.sum("weight").alias("w")),
         sql("aw bk", "select portfolio, scenario, sum(weight) w from aw cross join bk group by 1, 2"), "w")
register("SS5_scenario_book",
         lambda s, d: _assets(s, d).select("portfolio").distinct().join(F.broadcast(S.scenario_book(s).agg(F.collect_list(F.struct("scenario", "shocks")).alias("b"))))
         .select("portfolio", F.explode("b").alias("b")).select("portfolio", "b.scenario", F.explode("b.shocks").alias("key", "shock")),
         sql("az sh", "select portfolio, scenario, key, shock from (select distinct portfolio from az) cross join sh where scenario not like 'ccar%' and scenario not like 'basel%'"), "shock:9")
register("SS13_regulatory_scenarios",
         lambda s, d: S.run_scenarios(_assets(s, d), S.regulatory_scenarios(s), LIMITS).select("portfolio", "scenario", "portfolio_return"),
         sql("sx", "select portfolio, scenario, portfolio_return from sx where scenario like 'ccar%' or scenario like 'basel%'"), "portfolio_return")
register("SS7_portfolio_impact", lambda s, d: RUN(s, d).select("portfolio", "scenario", "portfolio_return", "pnl", "var_stressed", "liquidity_shortfall"),
         sql("sx", "select portfolio, scenario, portfolio_return, pnl, var_stressed, liquidity_shortfall from sx"), "portfolio_return pnl:7 var_stressed liquidity_shortfall:7")
register("SS8_scenario_drawdown", lambda s, d: RUN(s, d).select("portfolio", "scenario", "drawdown"), sql("sx", "select portfolio, scenario, drawdown from sx"), "drawdown")
register("SS9_recovery_days", lambda s, d: RUN(s, d).select("portfolio", "scenario", "recovery_days"), sql("sx", "select portfolio, scenario, recovery_days from sx"))
_SEC = " union all ".join(f"select portfolio, asset, weight, '{s}' sector from aw where " + " or ".join(f"contains(asset, '{k}')" for k in kws) for s, kws in S.SECTORS.items())
register("SS10_sector_impacts", lambda s, d: S.sector_impacts(_assets(s, d), _book(s)),
         sql("aw am", "select portfolio, scenario, sector, sum(weight * shock) / sum(weight) impact from sc join am using (asset) group by 1, 2, 3", sc=_SEC), "impact")
register("SS11_limit_breaches", lambda s, d: RUN(s, d).select("portfolio", "scenario", "drawdown_breach", "var_breach", "liquidity_breach"),
         sql("sb2", "select portfolio, scenario, drawdown_breach, var_breach, liquidity_breach from sb2"))
register("SS12_capital_adequacy", lambda s, d: RUN(s, d).select("portfolio", "scenario", "capital_ratio", "capital_surplus", "leverage"),
         sql("sb2", "select portfolio, scenario, capital_ratio, capital_surplus, leverage from sb2"), "capital_ratio capital_surplus:7 leverage")
register("SS4_result_analysis", lambda s, d: S.analyze(RUN(s, d)),
         sql("sx", """select portfolio, min(pnl) worst, max(pnl) best, avg(pnl) mean, stddev_pop(pnl) std, quantile_cont(pnl, 0.01) p1, quantile_cont(pnl, 0.05) p5,
         quantile_cont(pnl, 0.1) p10, quantile_cont(pnl, 0.9) p90, quantile_cont(pnl, 0.95) p95, quantile_cont(pnl, 0.99) p99 from sx group by 1"""),
         "worst best mean:4 std:4 p1:2 p5:2 p10:2 p90:2 p95:2 p99:2")
register("SS14_cross_scenario_summary", lambda s, d: S.summarize(RUN(s, d)),
         sql("sb2", """select portfolio, min(portfolio_return) worst_loss, max(portfolio_return) best_loss, avg(portfolio_return) average_loss, median(portfolio_return) median_loss,
         stddev_pop(portfolio_return) loss_volatility, max(drawdown) worst_drawdown, avg(recovery_days) average_recovery,
         count(*) filter (drawdown_breach or var_breach or liquidity_breach) scenarios_with_breaches, count(*) scenarios from sb2 group by 1"""),
         "worst_loss best_loss average_loss median_loss loss_volatility worst_drawdown average_recovery")
register("SS15_limit_alerts",
         lambda s, d: S.limit_alerts(RUN(s, d).groupBy("portfolio").agg(F.min("var_stressed").alias("var"), F.max("drawdown").alias("max_drawdown"),
                                                                      F.max("leverage").alias("leverage")), {"var": 1.0, "max_drawdown": 0.45, "leverage": 0.9}),
         sql("sb2", """select portfolio, metric, value, limit_value, breach_ratio, case when breach_ratio > 1.2 then 'HIGH' else 'MEDIUM' end severity from (
         select portfolio, unnest(['var', 'max_drawdown', 'leverage']) metric, unnest([v, m, l]) AS value, unnest([1.0::double, 0.45, 0.9]) limit_value,
         unnest([abs(v) / 1.0, m / 0.45, l / 0.9]) breach_ratio from (select portfolio, min(var_stressed) v, max(drawdown) m, max(leverage) l from sb2 group by 1)) where breach_ratio > 1"""),
         "value breach_ratio")
register("TK3_worst_scenario", lambda s, d: RUN(s, d).groupBy("portfolio").agg(F.min_by("scenario", F.struct("portfolio_return", "scenario")).alias("worst")),
         sql("sx", "select portfolio, scenario worst from sx qualify row_number() over (partition by portfolio order by portfolio_return, scenario) = 1"))
_SUPW = lambda s, d: P.normalize(X.positions(s, d).select("portfolio", "symbol", F.col("quantity").alias("weight")))
_SUPP = lambda s, d: X.suppliers(s, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
CTES["ws"] = "select portfolio, symbol, quantity / sum(quantity) over (partition by portfolio) weight from pos"
CTES["ps"] = "select symbol, arg_max(close, ts) price from sb group by symbol"
_NEEDS.update({"ws": "pos", "ps": "sb"})
WINDOWS = {"w1996": ("1996-01-01", "1996-06-30"), "w1999": ("1999-03-01", "1999-03-31")}
register("SS1_historical_stress", lambda s, d: S.historical_stress(X.supplier_returns(s, d), _SUPW(s, d), _SUPP(s, d), WINDOWS),
         sql("ws ps sr", """select portfolio, scenario, sum(weight * (select sum(price) from ps) * coalesce(worst, 0)) pnl from ws cross join
         (values ('w1996', timestamp '1996-01-01', timestamp '1996-06-30'), ('w1999', timestamp '1999-03-01', timestamp '1999-03-31')) v(scenario, a, b)
         left join (select symbol, scenario, min(ret) worst from sr join (values ('w1996', timestamp '1996-01-01', timestamp '1996-06-30'),
         ('w1999', timestamp '1999-03-01', timestamp '1999-03-31')) v(scenario, a, b) on ts between a and b group by 1, 2) using (symbol, scenario) group by 1, 2"""), "pnl:3")
HYP = {"down": {"S1": -0.3, "S2": -0.2, "S5": 0.1}, "up": {"S1": 0.2, "S7": 0.15}}
register("SS2_hypothetical_stress", lambda s, d: S.hypothetical_stress(_SUPW(s, d), _SUPP(s, d), HYP),
         sql("ws ps", """select portfolio, scenario, sum(weight * coalesce(shock, 0)) * any_value(v) pnl from ws join (select portfolio, sum(weight * coalesce(price, 100)) v
         from ws left join ps using (symbol) group by 1) using (portfolio) cross join (values ('down'), ('up')) c(scenario) left join (values ('down', 'S1', -0.3), ('down', 'S2', -0.2),
         ('down', 'S5', 0.1), ('up', 'S1', 0.2), ('up', 'S7', 0.15)) h(scenario, symbol, shock) using (scenario, symbol) group by 1, 2"""), "pnl")

# ESG
SEC = ["utilities", "technology", "steel", "financial", "mining", "other"]
LOC = ["coastal", "tropical", "temperate", "arctic", "desert", "inland"]


def _scores(s, d):
    k = F.col("s_suppkey")
    return read_table(s, d, "supplier").select(
        F.concat(F.lit("S"), k).alias("symbol"), F.col("s_nationkey").alias("portfolio"), (k % 100 / 10.0).alias("overall_score"),
        (k % 37 * 50 + 0.5).alias("carbon_intensity"), (k % 11 * 0.9).alias("climate_risk"),
        F.array(*[F.lit(x) for x in SEC])[(k % 6).cast("int")].alias("sector"), F.array(*[F.lit(x) for x in LOC])[F.floor(k / 6 % 6).cast("int")].alias("location"))


CTES["es"] = f"""select 'S' || s_suppkey symbol, s_nationkey portfolio, s_suppkey % 100 / 10.0::double overall_score, s_suppkey % 37 * 50 + 0.5::double carbon_intensity,
  s_suppkey % 11 * 0.9::double climate_risk, {_lst(SEC)}[s_suppkey % 6 + 1] sector, {_lst(LOC)}[s_suppkey // 6 % 6 + 1] AS location from supplier"""
CTES["cs"] = "select * from (values " + _values([(n, t, c[-1], tm, pm, po, te) for n, t, c, tm, pm, po, te in E.CLIMATE]) + ") t(scenario, temperature, carbon, tm, pm, po, te)"


def _case(col, table):
    return f"(case {col} " + " ".join(f"when '{k}' then {v}" for k, v in table.items() if k != "default") + f" else {table['default']} end)::double"


CI = f"""select symbol, scenario, least(0.5, 0.1 * power(temperature / 1.5, 2) * pm * {_case('sector', E.SECTOR_PHYSICAL)} * {_case('location', E.LOCATION)}) physical_risk,
  least(0.4, tm * (carbon_intensity * carbon / 1e6 + te * {_case('sector', E.SECTOR_TRANSITION)} * 0.1 + po * {_case('sector', E.SECTOR_TRANSITION)} * 0.05)) transition_risk from es cross join cs"""
register("EG1_physical_risk", lambda s, d: E.climate_impacts(_scores(s, d), E.climate_scenarios(s)).drop("transition_risk"),
         sql("es cs", f"select symbol, scenario, physical_risk from ({CI})"), "physical_risk:9")
register("EG2_transition_risk", lambda s, d: E.climate_impacts(_scores(s, d), E.climate_scenarios(s)).drop("physical_risk"),
         sql("es cs", f"select symbol, scenario, transition_risk from ({CI})"), "transition_risk:9")
register("JN12_dimension_multipliers",
         lambda s, d: _scores(s, d).select("symbol", E._mult(E.SECTOR_PHYSICAL, "sector").alias("sm"), E._mult(E.LOCATION, "location").alias("lm")),
         sql("es", f"select symbol, {_case('sector', E.SECTOR_PHYSICAL)} sm, {_case('location', E.LOCATION)} lm from es"))
PE = """select portfolio, (avg(overall_score) - 5) / 5 momentum, greatest(0, 0.04 * (1 - avg(overall_score) / 10)) risk_premium,
  greatest(0, (avg(overall_score) - 5) / 5) * 0.02 sustainable_alpha, sum(carbon_intensity) carbon_footprint, avg(climate_risk) climate_risk from es group by 1"""
register("EG3_portfolio_esg", lambda s, d: E.portfolio_esg(_scores(s, d)), sql("es", PE), "momentum risk_premium sustainable_alpha carbon_footprint climate_risk")
_PR = lambda s, d: X.supplier_returns(s, d).join(_scores(s, d).select("symbol", "portfolio"), "symbol").groupBy("portfolio", "ts").agg(F.avg("ret").alias("ret"))
NR = "select portfolio, ts, avg(ret) ret from sr join es using (symbol) group by 1, 2"
register("EG4_climate_var", lambda s, d: E.climate_var(_PR(s, d), E.portfolio_esg(_scores(s, d)), E.climate_scenarios(s)),
         sql("es cs sr", """select portfolio, scenario, p5 * (1 + climate_risk / 10 * pm * 0.5) climate_var from (select portfolio, quantile_cont(ret, 0.05) p5 from nr group by 1)
         join pe using (portfolio) cross join cs""", pe=PE, nr=NR), "climate_var")
register("EG5_adjusted_returns", lambda s, d: E.adjusted_returns(_PR(s, d), E.portfolio_esg(_scores(s, d))),
         sql("es sr", "select portfolio, ts, ret, ret + momentum * 0.001 - risk_premium / 252 adjusted_ret from nr join pe using (portfolio)", pe=PE, nr=NR), "ret adjusted_ret")
register("EG6_weighted_scores", lambda s, d: E.weighted_scores(_SUPW(s, d), _scores(s, d).where("carbon_intensity > 100"), 5.0, 900.0),
         sql("ws es", """select portfolio, esg_score, carbon, esg_score >= 5 score_ok, carbon <= 900 carbon_ok from (select ws.portfolio portfolio, sum(weight * coalesce(overall_score, 5)) esg_score,
         sum(weight * coalesce(carbon_intensity, 1000)) carbon from ws left join (select * from es where carbon_intensity > 100) e using (symbol) group by 1)"""), "esg_score:9 carbon:9")
register("EG7_esg_report",
         lambda s, d: E.climate_var(_PR(s, d), E.portfolio_esg(_scores(s, d)), E.climate_scenarios(s)).join(E.portfolio_esg(_scores(s, d)), "portfolio")
         .join(_scores(s, d).select("symbol", "portfolio").join(E.climate_impacts(_scores(s, d), E.climate_scenarios(s)), "symbol").groupBy("portfolio", "scenario").agg(
             F.avg("physical_risk").alias("physical"), F.avg("transition_risk").alias("transition")), ["portfolio", "scenario"]),
         sql("es cs sr", """select pe.*, scenario, p5 * (1 + climate_risk / 10 * pm * 0.5) climate_var, physical, transition from (select portfolio, quantile_cont(ret, 0.05) p5 from nr group by 1)
         join pe using (portfolio) cross join cs join (select portfolio, scenario, avg(physical_risk) physical, avg(transition_risk) transition from ci join es using (symbol) group by 1, 2)
         using (portfolio, scenario)""", pe=PE, nr=NR, ci=CI), "momentum risk_premium sustainable_alpha carbon_footprint climate_risk climate_var physical transition:9")

# crypto calibration
register("CR1_jump_statistics", lambda s, d: K.jump_statistics(X.supplier_returns(s, d), k=2.5),
         sql("sr", """select symbol, any_value(m) * 252 drift, any_value(sd) * sqrt(252) base_vol, count(*) filter (abs(ret) > 2.5 * sd) / (count(*) / 252) jump_intensity,
         avg(ret) filter (abs(ret) > 2.5 * sd) jump_mean, stddev_pop(ret) filter (abs(ret) > 2.5 * sd) jump_std from sr join (select symbol, avg(ret) m, stddev_pop(ret) sd from sr group by 1)
         using (symbol) group by 1"""), "drift base_vol jump_intensity jump_mean jump_std")
_V = "select * from (select *, stddev_samp(ret) over r * sqrt(252) vol, count(*) over r n from {t} window r as (partition by symbol order by ts rows between {k} preceding and current row)) where n = {k} + 1"
register("CR2_volatility_regimes", lambda s, d: K.volatility_regimes(X.supplier_returns(s, d)),
         sql("sr", """select symbol, (case when vol < a then 0 when vol < b then 1 else 2 end)::int regime, avg(ret) * 252 drift, avg(vol) mean_vol, count(*) n from v join
         (select symbol, quantile_cont(vol, 0.33) a, quantile_cont(vol, 0.66) b from v group by 1) using (symbol) group by 1, 2""", v=_V.format(t="sr", k=19)), "drift mean_vol")
_TAIL = "select symbol, back, ret from (select *, row_number() over (partition by symbol order by ts desc) back, count(*) over (partition by symbol) n from hr) where back <= (select min(n) from (select count(*) n from hr group by symbol))"
register("CR3_multi_coin_stats", lambda s, d: K.multi_coin(X.hourly_returns(s, d))[0],
         sql("hr", "select symbol, avg(ret) * 252 drift, stddev_pop(ret) * sqrt(252) vol from x group by 1", x=_TAIL), "drift vol")
register("CR3_multi_coin_correlation", lambda s, d: K.multi_coin(X.hourly_returns(s, d))[1],
         sql("hr", "select a.symbol sym_i, b.symbol sym_j, corr(a.ret, b.ret) corr from x a join x b on a.back = b.back and a.symbol <= b.symbol group by 1, 2", x=_TAIL), "corr")
register("CR4_peg_reversion", lambda s, d: K.peg_reversion(X.suppliers(s, d), 1500.0),
         sql("sb", """select symbol, reversion, calm_vol, stress_vol from (select symbol, -252 * covar_samp(ret, dev) / var_pop(dev) reversion from r group by 1) join
         (select symbol, quantile_cont(vol, 0.25) calm_vol, quantile_cont(vol, 0.95) stress_vol from v group by 1) using (symbol)""",
             r="""select * from (select symbol, ts, ln(close / lag(close) over w) ret, ln(lag(close) over w / 1500) dev from sb window w as (partition by symbol order by ts)) where ret is not null""",
             v=_V.format(t="r", k=9)), "reversion calm_vol stress_vol")


def _cr5(s, d):
    assets = X.panel_returns(s, d).groupBy("symbol").agg((F.avg("ret") * 252).alias("expected")).withColumns(
        {"liquidity": F.ascii("symbol") / 100.0, "regulatory": F.ascii("symbol") / 200.0})
    return K.candidate_scores(_grid(s), assets, P.risk_parity_scores(_grid(s), _cov3(s, d)).select("candidate", "variance"))


register("CR5_candidate_scores", _cr5,
         sql("c3", """select candidate, (r - 0.02) / sqrt(v) - 0.1 * l - 0.05 * g - 0.1 * h score from (select candidate, sum(w * e) r, sum(w * ascii(symbol) / 100.0::double) l,
         sum(w * ascii(symbol) / 200.0::double) g, sum(w * w) h from gr join (select symbol, avg(ret) * 252 e from pr group by 1) using (symbol) group by 1) join
         (select g.candidate, sum(g.w * h.w * cov) v from gr g join c3 on sym_i = g.symbol join gr h on h.candidate = g.candidate and h.symbol = sym_j group by 1) using (candidate)""",
             gr=_EV["gr"]), "score")
_CP = lambda s, d: X.ticks(s, d).select(F.col("symbol").alias("asset"), F.hour("ts").alias("step"), F.dayofmonth("ts").alias("path_id"), "price", "ts").groupBy(
    "asset", "path_id", "step").agg(F.max_by("price", "ts").alias("price"))
_CPS = "select symbol asset, day(ts) path_id, hour(ts) step, arg_max(price, ts) price from tk group by all"
register("CR6_path_expected_return", lambda s, d: K.path_expectations(_CP(s, d))[0],
         sql("tk", "select asset, avg(b / a - 1) expected from (select asset, path_id, arg_min(price, step) a, arg_max(price, step) b from p group by 1, 2) group by 1", p=_CPS), "expected")
register("CR6_path_mean_covariance", lambda s, d: K.path_expectations(_CP(s, d))[1],
         sql("tk", "select a.asset sym_i, b.asset sym_j, covar_samp(a.m, b.m) cov from z a join z b on a.step = b.step and a.asset <= b.asset group by 1, 2", p=_CPS,
             z="""select asset, step, avg(r) m from (select *, price / lag(price) over (partition by asset, path_id order by step) - 1 r from p) where r is not null group by 1, 2"""), "cov")
