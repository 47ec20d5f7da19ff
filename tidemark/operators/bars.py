"""Bars from ticks or finer bars."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRICES = ("open", "high", "low", "close")


def ohlcv(ticks: DataFrame, bucket: Column, tie: list[str], price: str = "price", volume: str = "volume") -> DataFrame:
    """One bar per (symbol, bucket). First/last follow the total order `tie`, so partial
    aggregation runs before the shuffle and a hot symbol ships one row per bucket and task."""
    at = F.struct(*tie) if len(tie) > 1 else F.col(tie[0])
    return (ticks.withColumn("_at", at).groupBy("symbol", bucket.alias("ts"))
            .agg(F.min_by(price, "_at").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, "_at").alias("close"), F.sum(volume).alias("volume")))


def resample(bars: DataFrame, frequency: str = "D") -> DataFrame:
    """D/W/M bars; weeks end on Sunday and months on their last day. A bucket needs one row
    with a value; columns that hold none in it are null."""
    label = {"D": F.date_trunc("day", "ts"),
             "W": F.date_trunc("week", "ts") + F.expr("INTERVAL 6 DAYS"),
             "M": F.last_day("ts").cast("timestamp")}[frequency]
    out = (bars.groupBy("symbol", label.alias("bucket"))
           .agg(F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open"),
                F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"),
                F.sum("volume").alias("volume")))
    return out.withColumnRenamed("bucket", "ts").na.drop("all", subset=[*PRICES, "volume"])
