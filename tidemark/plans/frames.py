"""Frames built from the driver tables: ticks, bars, panels, positions, trades."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators.bars import ohlcv
from tidemark.operators.indicators import log_return, simple_return
from tidemark.plans.session import read_table

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def ticks(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.col("value") + 10).alias("price"),
                    (F.col("event_id") % 100 + 1).alias("volume"))


def hourly(spark: SparkSession, root: str) -> DataFrame:
    """About 5 x 720 hourly bars, bounded by the calendar."""
    return ohlcv(ticks(spark, root), F.date_trunc("hour", "ts"), tie=["ts", "event_id"])


def daily(spark: SparkSession, root: str) -> DataFrame:
    return ohlcv(ticks(spark, root), F.date_trunc("day", "ts"), tie=["ts", "event_id"])


def _lines(spark: SparkSession, root: str, symbol) -> DataFrame:
    li = read_table(spark, root, "lineitem")
    return li.select(symbol.alias("symbol"), F.col("l_shipdate").alias("ts"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                     F.col("l_quantity").cast("long").alias("volume"), F.struct(*LINE_ORDER).alias("seq"))


def panel(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars of three symbols over 2,498 dates."""
    return ohlcv(_lines(spark, root, F.col("l_returnflag")), F.col("ts"), tie=["seq"])


def suppliers(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars per supplier: the number of symbols grows with the table."""
    return ohlcv(_lines(spark, root, F.concat(F.lit("S"), F.col("l_suppkey"))), F.col("ts"), tie=["seq"])


def last_prices(spark: SparkSession, root: str) -> DataFrame:
    """The last close per supplier, without the bars before it: one row per supplier and task is shuffled."""
    last = _lines(spark, root, F.col("l_suppkey")).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
    return last.select(F.concat(F.lit("S"), F.col("symbol")).alias("symbol"), "price")


def hourly_returns(spark, root) -> DataFrame:
    return log_return(hourly(spark, root)).select("symbol", "ts", "ret").where("ret is not null")


def panel_returns(spark, root) -> DataFrame:
    return simple_return(panel(spark, root)).select("symbol", "ts", "ret").where("ret is not null")


def supplier_closes(spark: SparkSession, root: str) -> DataFrame:
    """symbol, ts and close of `suppliers`: the last line of a day travels alone, and its price is taken from it."""
    own = F.struct(*[c for c in LINE_ORDER if c != "l_suppkey"])  # the same in all lines of a symbol
    li = read_table(spark, root, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), own.alias("_at"))
    last = li.groupBy("symbol", "ts").agg(F.max("_at").alias("_at"))
    return last.select(F.concat(F.lit("S"), F.col("symbol")).alias("symbol"), "ts", (F.col("_at.l_extendedprice") / F.col("_at.l_quantity")).alias("close"))


def supplier_returns(spark, root) -> DataFrame:
    return log_return(supplier_closes(spark, root)).select("symbol", "ts", "ret").where("ret is not null")


def benchmark_returns(spark, root) -> DataFrame:
    return panel_returns(spark, root).groupBy("ts").agg(F.avg("ret").alias("bench_ret"))


def positions(spark, root) -> DataFrame:
    """Portfolio = customer, instrument = supplier."""
    li = read_table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    o = read_table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy(F.col("o_custkey").alias("portfolio"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"))
            .agg(F.sum("l_quantity").alias("quantity"),
                 (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("avg_price")))


def trades(spark, root) -> DataFrame:
    """Buys, and sells where the line was returned; `seq` is a total order."""
    li = read_table(spark, root, "lineitem").select(*LINE_ORDER, "l_returnflag", "l_shipdate")
    o = read_table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("portfolio"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
                    F.col("l_shipdate").alias("ts"),
                    F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("action"),
                    F.col("l_quantity").alias("quantity"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.struct(*LINE_ORDER).alias("seq")))


def dirty(spark, root) -> DataFrame:
    """Hourly bars with planted faults, chosen by plain arithmetic on the row number `k` of the symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = hourly(spark, root).withColumn("k", F.row_number().over(w))
    k = F.col("k")
    b = b.select(
        "symbol", "ts", "k",
        F.when(k % 31 == 0, None).otherwise(F.col("open")).alias("open"),
        F.when(k % 37 == 0, F.col("low") - 1).when(k % 41 == 0, None).otherwise(F.col("high")).alias("high"),
        F.when(k % 43 == 0, F.col("high") + 1).when(k % 53 == 0, -F.col("low")).otherwise(F.col("low")).alias("low"),
        F.when(k % 29 == 0, None).when(k % 97 == 0, F.col("close") * 25).otherwise(F.col("close")).alias("close"),
        F.when(k % 23 == 0, None).when(k % 61 == 0, F.lit(0)).when(k % 67 == 0, F.lit(-5))
        .otherwise(F.col("volume")).cast("long").alias("volume"))
    again = b.where(k % 47 == 0).withColumn("k", k + 100000)
    return b.unionByName(again)


def states(spark, root) -> DataFrame:
    """State sequence per user: entity, ts, event_id, state."""
    e = read_table(spark, root, "events")
    return e.select(F.col("user_id").alias("entity"), "ts", "event_id", F.col("event_type").alias("state"))
