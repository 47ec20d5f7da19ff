"""Result tables on disk."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.session import materialized


def write_results(df: DataFrame, path: str, fmt: str = "parquet", per_symbol: bool = False, mode: str = "overwrite") -> None:
    """`per_symbol` gives each symbol a folder with one file: a symbol is dealt to one task, which sorts and streams it. Files
    grow with the symbols, not with symbols times tasks."""
    if per_symbol:
        spark = df.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        df = df.repartition(n, "symbol")  # a fixed number: small tables with many symbols are not put into one task
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy("symbol") if per_symbol else w).save(path)


def month_columns(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_market_data(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Month-partitioned store, sorted by symbol and time inside each file so that row-group statistics prune.
    The shuffle key adds a symbol hash: a month does not collapse into one task."""
    spread = month_columns(df, ts).withColumn("_h", F.pmod(F.xxhash64("symbol"), F.lit(16)))
    (spread.repartition("year", "month", "_h").drop("_h").sortWithinPartitions("year", "month", "symbol", ts)
     .write.mode(mode).partitionBy("year", "month").parquet(path))


def upsert_risk(df: DataFrame, path: str, version: str | None = None) -> None:
    """One row per (portfolio, calculation_date): incoming rows replace theirs, all other rows of the store stay.

    Of incoming rows for one key, the one with the largest `version` wins; without a version column a repeated key is
    an error. The touched dates are merged and cut from their source by a checkpoint before they are written over.
    """
    spark, keys = df.sparkSession, ["portfolio", "calculation_date"]
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*rest), F.col(version) if version else F.lit(1)).alias("_r"))
    rows = materialized(rows)
    if not version and rows.where("_n > 1").take(1):
        raise ValueError("repeated (portfolio, calculation_date); name a version column")
    one = rows.select("portfolio", "_r.*", "calculation_date")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        dates = one.select("calculation_date").distinct()
        old = spark.read.parquet(path)
        kind = one.schema["calculation_date"].dataType
        old = old.withColumn("calculation_date", F.col("calculation_date").cast(kind)).join(dates, "calculation_date", "left_semi")
        one = materialized(one.unionByName(old.join(one.select(*keys), keys, "left_anti")))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calculation_date").parquet(path)


def job_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Status, counts and run time per job kind, newest first when listed."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"),
                                   F.avg("seconds").alias("mean_seconds"), F.max("ts").alias("last_run"))
