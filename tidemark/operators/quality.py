"""Data-quality score, validation rules and their report rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType, TimestampType

from tidemark.operators import aggregate as G
from tidemark.operators.align import missing_day_gaps
from tidemark.operators.bars import PRICES
from tidemark.operators.indicators import simple_return
from tidemark.plans.session import materialized

# Accepted ranges per column.
RANGES = {"open": (0.01, 1e6), "high": (0.01, 1e6), "low": (0.01, 1e6), "close": (0.01, 1e6), "volume": (0.0, 1e12)}


def _rule(name: str, severity: str, bad: Column, affected: Column) -> Column:
    return F.struct(F.lit(name).alias("rule"), F.when(bad, F.lit(severity)).otherwise(F.lit("INFO")).alias("severity"),
                    (~bad).alias("is_valid"), F.when(bad, affected).otherwise(F.lit(0)).cast("long").alias("affected"))


def schema_rule(df: DataFrame, required=("close",)) -> tuple[bool, list[str]]:
    missing = [c for c in required if c not in df.columns]
    return not missing, missing


def type_rule(df: DataFrame, kinds: dict[str, str]) -> tuple[bool, list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    want = {"numeric": NumericType, "datetime": TimestampType, "string": StringType}
    wrong = [c for c, k in kinds.items() if c in types and not (
        isinstance(types[c], want[k]) if k in want else k in types[c].simpleString())]
    return not wrong, wrong


def range_report(df: DataFrame, ranges=None, keys=("symbol",)) -> DataFrame:
    """Violations with the actual extremes, one row per key and column."""
    ranges = ranges or RANGES
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"_{c}.n").alias("violations"), F.col(f"_{c}.a").alias("min_actual"),
        F.col(f"_{c}.b").alias("max_actual")) for c in ranges])
    agg = df.groupBy(*keys).agg(*[F.struct(
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("n"), F.min(c).cast("double").alias("a"),
        F.max(c).cast("double").alias("b")).alias(f"_{c}") for c, (lo, hi) in ranges.items()])
    return agg.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*").where("violations > 0")


def validate(df: DataFrame, keys=("symbol",), ranges=None, max_missing: float = 5.0,
             skip: tuple[str, ...] = (), custom: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None) -> DataFrame:
    """All rules as rows (keys, rule, severity, is_valid, affected).

    The default rules share one aggregation over the table. A custom rule maps the frame to
    rows (keys, is_valid) and is unioned in.
    """
    ranges = ranges or RANGES
    n = F.count(F.lit(1))
    cols = [c for c in (*PRICES, "volume") if c in df.columns]
    anynull = F.lit(False)
    for c in cols:
        anynull = anynull | F.col(c).isNull()
    agg = df.groupBy(*keys).agg(
        n.alias("n"), sum(F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in ranges.items() if c in cols).alias("rng"),
        (sum(F.count_if(c) for c in (
            F.col("high") < F.col("low"), F.col("high") < F.col("open"), F.col("high") < F.col("close"),
            F.col("low") > F.col("open"), F.col("low") > F.col("close"), F.col("volume") < 0))).alias("cons"),
        F.count_if(F.col("close").isNull()).alias("noclose"), F.count_if(anynull).alias("anynull"))
    days = df.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum(F.col("c") - 1).alias("dup"))
    ok_schema, missing = schema_rule(df)
    ok_types, wrong = type_rule(df, {c: "numeric" for c in (*PRICES, "volume")})
    pct = 100.0 * F.col("anynull") / F.col("n")
    crit = F.col("noclose") > 0
    rules = {
        "schema": _rule("schema", "CRITICAL", F.lit(not ok_schema), F.lit(len(missing))),
        "types": _rule("types", "ERROR", F.lit(not ok_types), F.lit(len(wrong))),
        "range": _rule("range", "WARNING", F.col("rng") > 0, F.col("rng")),
        "consistency": _rule("consistency", "ERROR", F.col("cons") > 0, F.col("cons")),
        "completeness": F.struct(
            F.lit("completeness").alias("rule"),
            F.when(crit, "CRITICAL").when(pct > max_missing, "WARNING").otherwise("INFO").alias("severity"),
            (~(crit | (pct > max_missing))).alias("is_valid"),
            F.when(crit, F.lit(0)).when(pct > max_missing, F.col("anynull")).otherwise(F.lit(0)).cast("long").alias("affected")),
        "uniqueness": _rule("uniqueness", "ERROR", F.col("dup") > 0, F.col("dup")),
    }
    picked = F.array(*[v for k, v in rules.items() if k not in skip])
    out = agg.join(days, list(keys)).select(*keys, F.explode(picked).alias("e")).select(*keys, "e.*")
    for name, (severity, fn) in (custom or {}).items():
        got = fn(df).select(*keys, "is_valid")
        out = out.unionByName(got.select(
            *keys, F.lit(name).alias("rule"), F.when(F.col("is_valid"), "INFO")
            .otherwise(severity).alias("severity"), "is_valid", F.lit(0).cast("long").alias("affected")))
    return out


def overall(results: DataFrame, keys=("symbol",)) -> DataFrame:
    failed = ~F.col("is_valid") & F.col("severity").isin("CRITICAL", "ERROR")
    return results.groupBy(*keys).agg((F.count_if(failed) == 0).alias("is_valid"), F.count_if(~F.col("is_valid")).alias("failed_rules"))


def outlier_rule(df: DataFrame, cols, method: str = "iqr", max_pct: float = 5.0, keys=("symbol",), split=False) -> DataFrame:
    out = None
    for c in cols:
        n = df.groupBy(*keys).agg(F.count(c).alias("n"))
        one = G.outliers(df, c, method, keys=keys, split=split).join(n, list(keys)).select(
            *keys, F.lit(c).alias("column"), "n_outliers", (100.0 * F.col("n_outliers") / F.col("n")).alias("pct"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("exceeded", F.col("pct") > max_pct)


def quality_report(df: DataFrame, method: str = "iqr", split=False) -> DataFrame:
    """Per symbol: missing share, integrity counters, outliers, gaps, score, issues, warnings, advice."""
    keys = ["symbol"]
    df = materialized(df)  # read by every counter below
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    miss = G.missing_report(df).select("symbol", F.col("any_pct").alias("missing_pct"))
    outl = {c: G.outliers(df, c, method, split=split).withColumnRenamed("n_outliers", f"{name}_outliers")
            for c, name in (("close", "price"), ("volume", "volume"))}
    rets = simple_return(df, split=split)
    gaps = missing_day_gaps(df).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    j = base.join(miss, keys).join(G.integrity(df), keys)
    for o in outl.values():
        j = j.join(o, keys, "left")
    j = j.join(G.outliers(rets, "ret", method, split=split).withColumnRenamed("n_outliers", "return_outliers"), keys, "left")
    j = j.join(gaps, keys, "left").na.fill(0, ["gaps", "price_outliers", "volume_outliers", "return_outliers"])
    n = F.col("n")
    score = (100 - 0.5 * F.col("missing_pct") - 0.8 * 100 * (F.col("negative_prices") + F.col("price_inconsistencies")) / n
             - 0.3 * 100 * (F.col("price_outliers") + F.col("volume_outliers")) / n - 2 * F.col("gaps"))
    def notes(*pairs):
        return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))
    return j.withColumns({
        "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)),
        "issues": notes((F.col("missing_pct") > 20, "missing data"), (F.col("negative_prices") > 0, "non-positive prices"),
                        (F.col("price_inconsistencies") > 0, "price inconsistencies")),
        "warnings": notes((F.col("gaps") > 5, "date gaps"), (F.col("price_outliers") > 6 * 0.05, "price outliers"),
                          (F.col("zero_volume") > 0, "zero volume")),
        "advice": notes((F.col("missing_pct") > 5, "impute missing rows"), (F.col("return_outliers") > 0, "review return outliers"),
                        (F.col("gaps") > 0, "fill date gaps"))})
