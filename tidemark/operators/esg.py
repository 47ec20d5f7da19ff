"""Climate and ESG table analytics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.scalar import steady_sum
from tidemark.operators.stress import pick

# Climate scenarios.
CLIMATE = [
    ("RCP26", 1.5, [50.0, 75.0, 100.0, 125.0, 150.0], 2.0, 1.0, 0.9, 0.8),
    ("RCP45", 2.5, [30.0, 40.0, 50.0, 60.0, 70.0], 1.5, 1.5, 0.6, 0.5),
    ("RCP85", 4.0, [10.0, 15.0, 20.0, 25.0, 30.0], 0.5, 3.0, 0.2, 0.2),
]
# Multipliers for physical and transition risk ('default' applies to other names).
SECTOR_PHYSICAL = {"utilities": 2.0, "real_estate": 1.8, "agriculture": 2.5, "insurance": 1.5, "tourism": 2.0, "manufacturing": 1.3,
                   "technology": 0.8, "financial": 1.0, "default": 1.2}
LOCATION = {"coastal": 1.5, "tropical": 1.7, "temperate": 1.0, "arctic": 2.0, "desert": 1.3, "default": 1.2}
SECTOR_TRANSITION = {"energy_fossil": 3.0, "utilities_coal": 2.8, "steel": 2.5, "cement": 2.3, "airlines": 2.2, "shipping": 2.0,
                     "automotive_ice": 2.0, "chemicals": 1.8, "mining": 1.7, "technology": 0.5, "financial": 0.8, "healthcare": 0.6, "default": 1.0}


def climate_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLIMATE, "scenario string, temperature double, carbon_prices array<double>, transition_mult double, "
                                          "physical_mult double, policy double, technology double")


def _mult(table: dict[str, float], key: str) -> Column:
    return pick({k: v for k, v in table.items() if k != "default"}, F.lower(key), table["default"])


def with_scenarios(symbols: DataFrame, scenarios: DataFrame) -> DataFrame:
    packed = scenarios.agg(F.collect_list(F.struct(*scenarios.columns)).alias("_s"))  # one row
    return symbols.join(F.broadcast(packed)).withColumn("_e", F.explode("_s")).select(*symbols.columns, "_e.*")


def climate_impacts(symbols: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Physical and transition risk per (symbol, scenario). `symbols`: symbol, sector, location, carbon_intensity."""
    x = with_scenarios(symbols, scenarios)
    physical = 0.1 * F.pow(F.col("temperature") / 1.5, 2) * F.col("physical_mult") * _mult(SECTOR_PHYSICAL, "sector") * _mult(LOCATION, "location")
    m = _mult(SECTOR_TRANSITION, "sector")
    transition = F.col("transition_mult") * (F.col("carbon_intensity") * F.element_at("carbon_prices", -1) / 1e6
                                             + F.col("technology") * m * 0.1 + F.col("policy") * m * 0.05)
    return x.select("symbol", "scenario", F.least(physical, F.lit(0.5)).alias("physical_risk"), F.least(transition, F.lit(0.4)).alias("transition_risk"))


def portfolio_esg(scores: DataFrame, key: str = "portfolio") -> DataFrame:
    """Momentum, risk premium, sustainable alpha from the mean score; carbon footprint."""
    avg = F.avg("overall_score")
    return scores.groupBy(key).agg(
        ((avg - 5) / 5).alias("momentum"), F.greatest(F.lit(0.0), 0.04 * (1 - avg / 10)).alias("risk_premium"),
        (F.greatest(F.lit(0.0), (avg - 5) / 5) * 0.02).alias("sustainable_alpha"), F.sum("carbon_intensity").alias("carbon_footprint"),
        F.avg("climate_risk").alias("climate_risk"))


def climate_var(rets: DataFrame, esg: DataFrame, scenarios: DataFrame, key: str = "portfolio") -> DataFrame:
    """5% quantile of the portfolio returns x (1 + climate risk / 10 x multiplier / 2)."""
    base = rets.groupBy(key).agg(F.percentile("ret", 0.05).alias("_p5")).join(esg.select(key, "climate_risk"), key)
    x = with_scenarios(base, scenarios.select("scenario", "physical_mult"))
    return x.select(key, "scenario", (F.col("_p5") * (1 + F.col("climate_risk") / 10 * F.col("physical_mult") * 0.5)).alias("climate_var"))


def adjusted_returns(rets: DataFrame, esg: DataFrame, key: str = "portfolio") -> DataFrame:
    return rets.join(esg.select(key, "momentum", "risk_premium"), key).withColumn(
        "adjusted_ret", F.col("ret") + F.col("momentum") * 0.001 - F.col("risk_premium") / 252).drop("momentum", "risk_premium")


def weighted_scores(weights: DataFrame, scores: DataFrame, min_score: float, max_carbon: float, key: str = "portfolio") -> DataFrame:
    """Weighted ESG score and carbon (defaults 5 and 1000) with constraint flags."""
    j = weights.join(scores.select("symbol", "overall_score", "carbon_intensity"), "symbol", "left")
    out = j.groupBy(key).agg(steady_sum(F.col("weight") * F.coalesce("overall_score", F.lit(5.0))).alias("esg_score"),
                             steady_sum(F.col("weight") * F.coalesce("carbon_intensity", F.lit(1000.0))).alias("carbon"))
    return out.withColumns({"score_ok": F.col("esg_score") >= min_score, "carbon_ok": F.col("carbon") <= max_carbon})
