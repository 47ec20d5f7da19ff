"""Scenario books, shock matching and stress results for tables of portfolios."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.mathx import z_value

# Severity level and its multiplier for historical crises.
SEVERITY = {"MILD": (1, 0.5), "MODERATE": (2, 0.75), "SEVERE": (3, 1.0), "EXTREME": (4, 1.5)}
# Historical crises (missing entries use the defaults in `scenario_book`).
CRISES = {
    "black_monday_1987": {"equity": -0.22, "bond": 0.05, "vol": 3.0, "days": 5, "pattern": "V"},
    "dot_com_crash_2000": {"equity": -0.49, "bond": 0.15, "vol": 2.5, "days": 912, "pattern": "U"},
    "lehman_crisis_2008": {"equity": -0.38, "bond": -0.25, "vol": 4.0, "liquidity": 0.8, "days": 547, "pattern": "U"},
    "covid_crash_2020": {"equity": -0.34, "bond": 0.08, "oil": -0.65, "vol": 5.0, "days": 33, "pattern": "V"},
    "european_debt_crisis_2011": {"equity": -0.25, "bond": -0.15, "days": 180, "pattern": "L"},
}
# Geopolitical events: shocks in order, duration range, recovery pattern.
GEOPOLITICAL = {
    "trade_war": ({"equity_US": -0.15, "equity_China": -0.20, "equity_EU": -0.10, "currency_USD": 0.05, "currency_CNY": -0.08,
                   "currency_EUR": 0.02}, (180, 720), "L"),
    "military_conflict": ({"equity_global": -0.25, "equity_regional": -0.40, "energy": 0.30, "gold": 0.20, "treasuries": 0.15}, (30, 365), "W"),
    "sanctions_regime": ({"equity_target": -0.35, "equity_allied": -0.10, "currency_target": -0.25, "currency_allied": 0.05}, (90, 1095), "L"),
    "political_instability": ({"equity_domestic": -0.20, "equity_global": -0.05, "currency_domestic": -0.15}, (60, 270), "U"),
}
# Liquidity crisis impacts and durations.
LIQUIDITY = {"government_bonds": 0.05, "investment_grade_bonds": 0.15, "high_yield_bonds": 0.40, "equity_large_cap": 0.10,
             "equity_small_cap": 0.30, "emerging_markets": 0.50, "alternatives": 0.70, "real_estate": 0.60}
LIQUIDITY_DAYS = {"MILD": 7, "MODERATE": 21, "SEVERE": 60, "EXTREME": 180}
# Regulatory scenarios.
REGULATORY = {
    "ccar_severely_adverse_2025": dict(
        probability=0.10, days=365, pattern="U", shocks={"equity": -0.25, "real_estate": -0.20, "corporate_bonds": -0.15, "commodities": -0.10},
        vols={"equity": 2.0, "bonds": 1.5}, liquidity={"corporate_bonds": 0.3, "equity": 0.1}),
    "basel_iii_market_risk": dict(
        probability=0.01, days=250, pattern="L", shocks={"equity": -0.30, "credit_spreads": 0.04, "interest_rates": 0.02, "currencies": -0.15,
                                                         "commodities": -0.20},
        vols={"all_assets": 3.0}, liquidity={"credit": 0.5, "equity": 0.2}),
}
# Asset-class keywords, default keys, sector keywords.
CLASSES = {"equity": ["stock", "share", "equity", "fund"], "bonds": ["bond", "treasury", "corporate", "govt"],
           "commodities": ["gold", "oil", "commodity", "metal"], "real_estate": ["reit", "real_estate", "property"],
           "alternatives": ["hedge", "private", "alternative"]}
DEFAULT_KEYS = ["equity", "equity_global", "global", "market"]
SECTORS = {"technology": ["tech", "software", "semiconductor"], "financial": ["bank", "insurance", "financial"],
           "energy": ["oil", "gas", "energy", "utility"], "healthcare": ["pharma", "healthcare", "biotech"],
           "consumer": ["retail", "consumer", "discretionary"]}
# Drawdown and recovery factors by pattern and stress type.
DRAWDOWN_FACTOR = {"V": 1.0, "U": 1.2, "L": 1.5, "W": 1.3}
RECOVERY_FACTOR = {"V": 0.3, "U": 1.0, "L": 3.0, "W": 1.5}
TYPE_FACTOR = {"market_crash": 1.0, "liquidity_crisis": 0.5, "credit_crisis": 2.0, "geopolitical_event": 1.5, "pandemic": 1.2}

BOOK = ("scenario string, stress_type string, severity string, probability double, duration_days int, pattern string")


_MAPS = ("shocks", "vols", "liquidity")


def _frame(spark: SparkSession, rows, head: str) -> DataFrame:
    """Rows whose last three values are dicts. They travel as ordered entries, because a Python dict
    does not keep its order on the way into a map column and shock matching depends on it."""
    pairs = ", ".join(f"{m} array<struct<key:string,value:double>>" for m in _MAPS)
    data = [(*r[:-3], *[list(m.items()) for m in r[-3:]]) for r in rows]
    return spark.createDataFrame(data, f"{head}, {pairs}").withColumns({m: F.map_from_entries(m) for m in _MAPS})


def _scaled(col: str, factor: Column) -> Column:
    return F.transform_values(col, lambda _, v: v * factor)


def scenario_book(spark: SparkSession) -> DataFrame:
    """Every template at every severity: templates explode over the severity table, maps scale with it."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("severity"), F.lit(v).alias("level"), F.lit(m).alias("m")) for n, (v, m) in SEVERITY.items()]))
    hist = []
    for n, c in CRISES.items():
        eq, liq, vol = c["equity"], c.get("liquidity", 0.3), c.get("vol", 2.0)
        hist.append((n, c["days"], c["pattern"],
                     {"equity": eq, "bonds": c["bond"], "commodities": c.get("oil", -0.1), "real_estate": eq * 0.7, "alternatives": eq * 0.5},
                     {"equity": vol, "bonds": vol * 0.6, "commodities": vol * 1.2, "currencies": vol * 0.8},
                     {"equity": liq, "corporate_bonds": liq * 1.5, "alternatives": liq * 2.0}))
    h = _frame(spark, hist, "name string, days int, pattern string").select("*", levels.alias("s")).select("*", "s.*")
    h = h.select(F.concat(F.lit("historical_"), "name", F.lit("_"), F.lower("severity")).alias("scenario"), F.lit("market_crash").alias("stress_type"),
                 "severity", (0.05 / F.col("level")).alias("probability"), F.floor(F.col("days") * (0.5 + 0.5 * F.col("m"))).cast("int").alias("duration_days"),
                 "pattern", _scaled("shocks", F.col("m")).alias("shocks"), _scaled("vols", F.col("m")).alias("vols"),
                 _scaled("liquidity", F.col("m")).alias("liquidity"))
    geo = [(n, lo, hi, p, s, {"equity": 1.0, "currencies": 1.2, "commodities": 0.8},
            {"emerging_markets": 0.4, "developed_markets": 0.1, "commodities": 0.2}) for n, (s, (lo, hi), p) in GEOPOLITICAL.items()]
    g = _frame(spark, geo, "name string, lo int, hi int, pattern string").select("*", levels.alias("s")).select("*", "s.*")
    f = 0.5 + (F.col("level") - 1) * 0.5
    g = g.select(F.concat(F.lit("geopolitical_"), "name", F.lit("_"), F.lower("severity")).alias("scenario"), F.lit("geopolitical_event").alias("stress_type"),
                 "severity", (0.02 * (5 - F.col("level"))).alias("probability"),
                 F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("level") - 1) / 3).cast("int").alias("duration_days"), "pattern",
                 _scaled("shocks", f).alias("shocks"), _scaled("vols", 1.5 + F.col("level") * 0.3).alias("vols"), _scaled("liquidity", f).alias("liquidity"))
    liq = _frame(spark, [("bank_run", {}, {}, LIQUIDITY)], "name string").select("*", levels.alias("s")).select("*", "s.*")
    liq = liq.withColumn("liquidity", _scaled("liquidity", F.col("level") / 2))
    liq = liq.select(F.concat(F.lit("liquidity_crisis_bank_run_"), F.lower("severity")).alias("scenario"), F.lit("liquidity_crisis").alias("stress_type"),
                     "severity", F.lit(0.03).alias("probability"), pick(LIQUIDITY_DAYS, F.col("severity"), 0).cast("int").alias("duration_days"),
                     F.when(F.col("level") <= 2, "V").otherwise("U").alias("pattern"), _scaled("liquidity", F.lit(-0.5)).alias("shocks"),
                     F.transform_values("liquidity", lambda _, v: (2.0 + F.col("level") * 0.5) * (1 + v)).alias("vols"), "liquidity")
    return h.unionByName(g).unionByName(liq)


def regulatory_scenarios(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(n, "market_crash", "SEVERE", r["probability"], r["days"], r["pattern"], r["shocks"], r["vols"], r["liquidity"])
                          for n, r in REGULATORY.items()], BOOK)


def _any(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def find_shock(asset: Column, shocks: Column) -> Column:
    """Exact key; else the first key in map order that fits by asset class or by a name token;
    else the default keys; else 0."""
    low = F.lower(asset)
    tokens = F.split(low, "_")

    def fits(e):
        key = F.lower(e["key"])
        by_class = _any((_any(low.contains(k) for k in kws)) & (key.contains(cat) | F.lit(cat).contains(key)) for cat, kws in CLASSES.items())
        return by_class | F.exists(tokens, lambda t: key.contains(t))

    first = F.filter(F.map_entries(shocks), fits)
    return F.coalesce(F.try_element_at(shocks, asset), F.try_element_at(first, F.lit(1))["value"],
                      *[F.try_element_at(shocks, F.lit(k)) for k in DEFAULT_KEYS], F.lit(0.0))


def find_liquidity(asset: Column, impacts: Column) -> Column:
    """First impact whose key holds the asset name or is held by it, else 0."""
    low = F.lower(asset)
    hits = F.filter(F.map_entries(impacts), lambda e: F.lower(e["key"]).contains(low) | low.contains(F.lower(e["key"])))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["value"], F.lit(0.0))


def asset_shocks(assets: DataFrame, book: DataFrame) -> DataFrame:
    """(asset, scenario) -> shock, liquidity impact; the book is one broadcast row that each asset explodes."""
    packed = book.agg(F.collect_list(F.struct(*book.columns)).alias("_book"))
    x = assets.select("asset").distinct().join(F.broadcast(packed)).select("asset", F.explode("_book").alias("b"))
    return x.select("asset", F.col("b.scenario").alias("scenario"), find_shock(F.col("asset"), F.col("b.shocks")).alias("shock"),
                    find_liquidity(F.col("asset"), F.col("b.liquidity")).alias("liquidity_impact"))


def run_scenarios(pos: DataFrame, book: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row per portfolio and scenario. `pos`: portfolio, asset, weight, total_value."""
    shocks = asset_shocks(pos, book)
    hit = pos.join(shocks, "asset").groupBy("portfolio", "scenario").agg(
        F.sum(F.col("weight") * F.col("shock")).alias("portfolio_return"), F.max("total_value").alias("total_value"),
        F.sum(F.col("weight") * F.col("liquidity_impact")).alias("_liq"))
    vols = F.map_values("vols")
    meta = book.select("scenario", "stress_type", "pattern", "duration_days",
                       (F.aggregate(vols, F.lit(0.0), lambda a, v: a + v) / F.size(vols)).alias("vol_spike"))
    j = hit.join(F.broadcast(meta), "scenario")  # one row per scenario of the book
    r = F.col("portfolio_return")
    dd = F.abs(r) * pick(DRAWDOWN_FACTOR, F.col("pattern"), 1.0)
    loss = F.abs(r)
    j = j.withColumns({"pnl": r * F.col("total_value"), "drawdown": dd,
                       "var_stressed": z_value(0.05) * F.abs(r) * 2 * F.col("vol_spike"),
                       "liquidity_shortfall": F.col("total_value") * F.col("_liq"), "recovery_days": recovery_days()})
    ratio = F.greatest(F.lit(0.0), 0.12 - loss)
    return j.withColumns({
        "drawdown_breach": F.col("drawdown") > limits["max_drawdown"], "var_breach": F.abs("var_stressed") > limits["var_limit"],
        "liquidity_breach": F.col("liquidity_shortfall") > limits["liquidity_minimum"] * F.col("total_value"),
        "capital_ratio": ratio, "capital_surplus": (ratio - 0.08) * F.col("total_value"),
        "leverage": F.when(loss < 1, 1 / (1 + loss)).otherwise(F.lit(0.0))}).drop("_liq")


def pick(table: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def recovery_days() -> Column:
    raw = F.col("duration_days") * pick(TYPE_FACTOR, F.col("stress_type"), 1.0) * pick(RECOVERY_FACTOR, F.col("pattern"), 1.0)
    return F.floor(raw).cast("int")


def sector_impacts(pos: DataFrame, book: DataFrame) -> DataFrame:
    """Weighted mean shock of the assets whose name holds a keyword of the sector."""
    low = F.lower("asset")
    tags = F.filter(F.array(*[F.when(_any(low.contains(k) for k in kws), F.lit(s)) for s, kws in SECTORS.items()]), lambda s: s.isNotNull())
    x = pos.withColumn("sector", F.explode(tags)).join(asset_shocks(pos, book), "asset")
    return (x.groupBy("portfolio", "scenario", "sector").agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("shock")).alias("_s"))
            .where("_w > 0").select("portfolio", "scenario", "sector", (F.col("_s") / F.col("_w")).alias("impact")))


def historical_stress(rets: DataFrame, weights: DataFrame, prices: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Worst return of each asset inside each window times weight x Σ prices; unseen assets lose nothing."""
    spans = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).cast("timestamp").alias("a"), F.lit(b).cast("timestamp").alias("b"))
                      for n, (a, b) in windows.items()])
    worst = (rets.withColumn("w", F.explode(spans)).where(F.col("ts").between(F.col("w.a"), F.col("w.b")))
             .groupBy("symbol", F.col("w.scenario").alias("scenario")).agg(F.min("ret").alias("worst")))
    total = prices.agg(F.sum("price").alias("_sum"))
    grid = weights.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in windows])))
    j = grid.join(worst, ["symbol", "scenario"], "left").join(F.broadcast(total))  # one row
    return j.groupBy("portfolio", "scenario").agg(F.sum(F.col("weight") * F.col("_sum") * F.coalesce("worst", F.lit(0.0))).alias("pnl"))


def hypothetical_stress(pos: DataFrame, prices: DataFrame, scenarios: dict[str, dict[str, float]], default_price: float = 100.0) -> DataFrame:
    """pnl = Σ weight x (Σ weight x price) x shock per portfolio and scenario."""
    p = pos.join(prices, "symbol", "left").withColumn("price", F.coalesce("price", F.lit(default_price)))
    value = p.groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("price")).alias("_value"))
    maps = F.array(*[F.struct(F.lit(n).alias("scenario"), F.create_map(*[F.lit(x) for kv in m.items() for x in kv]).alias("m")) for n, m in scenarios.items()])
    x = p.withColumn("s", F.explode(maps)).withColumn("shock", F.coalesce(F.try_element_at("s.m", F.col("symbol")), F.lit(0.0)))
    return (x.groupBy("portfolio", F.col("s.scenario").alias("scenario")).agg(F.sum(F.col("weight") * F.col("shock")).alias("_r"))
            .join(value, "portfolio").select("portfolio", "scenario", (F.col("_r") * F.col("_value")).alias("pnl")))


def analyze(results: DataFrame, col: str = "pnl", keys=("portfolio",)) -> DataFrame:
    """Worst, best, mean, std and percentiles over scenarios (their number is the book's size)."""
    qs = {"p1": .01, "p5": .05, "p10": .1, "p90": .9, "p95": .95, "p99": .99}
    out = results.groupBy(*keys).agg(F.min(col).alias("worst"), F.max(col).alias("best"), F.avg(col).alias("mean"),
                                     F.stddev_pop(col).alias("std"), F.percentile(col, list(qs.values())).alias("_q"))
    return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(qs)]).drop("_q")


def summarize(results: DataFrame, keys=("portfolio",)) -> DataFrame:
    breach = F.col("drawdown_breach") | F.col("var_breach") | F.col("liquidity_breach")
    r = "portfolio_return"
    return results.groupBy(*keys).agg(
        F.min(r).alias("worst_loss"), F.max(r).alias("best_loss"), F.avg(r).alias("average_loss"), F.percentile(r, 0.5).alias("median_loss"),
        F.stddev_pop(r).alias("loss_volatility"), F.max("drawdown").alias("worst_drawdown"), F.avg("recovery_days").alias("average_recovery"),
        F.count_if(breach).alias("scenarios_with_breaches"), F.count(F.lit(1)).alias("scenarios"))


def limit_alerts(metrics: DataFrame, limits: dict[str, float], key: str = "portfolio") -> DataFrame:
    """Metric-versus-limit alerts; HIGH above 1.2 times the limit. Loss metrics compare by size."""
    tall = metrics.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("limit_value"))
                                                   for m, v in limits.items()])).alias("e")).select(key, "e.*")
    size = F.when(F.col("metric").isin("var", "expected_shortfall", "max_drawdown"), F.abs("value")).otherwise(F.col("value"))
    ratio = size / F.abs("limit_value")
    return tall.where(ratio > 1).select(key, "metric", "value", "limit_value", ratio.alias("breach_ratio"),
                                        F.when(ratio > 1.2, "HIGH").otherwise("MEDIUM").alias("severity"))
