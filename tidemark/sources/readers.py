"""Bars and payloads from files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
# Exchange symbol to coin id.
COIN_IDS = {"BTC": "bitcoin", "ETH": "ethereum", "ADA": "cardano", "SOL": "solana"}


def read_bars(spark: SparkSession, path: str | list[str], fmt: str, schema: str | StructType = BAR_SCHEMA, required: tuple[str, ...] = (), **options) -> DataFrame:
    """CSV, JSON or Parquet with a declared schema; missing required columns are an error before any work runs."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format {fmt}")
    if fmt == "csv":
        options = {"header": True, **options}
        first = spark.read.options(header=True).csv(path).columns
        absent = [c for c in required if c not in first]
    else:
        names = spark.read.schema(schema).format(fmt).load(path).columns
        absent = [c for c in required if c not in names]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def _files(spark: SparkSession, folder: str, symbols: list[str], fmt: str) -> dict[str, str]:
    """Symbol -> path of the files `folder/<symbol>.<fmt>` that exist; a missing folder is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    wanted = {f"{s}.{fmt}": s for s in symbols}
    return {wanted[n]: f"{folder}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(path)) if n in wanted}


def read_many(spark: SparkSession, folder: str, symbols: list[str], fmt: str = "csv", schema: str | StructType = BAR_SCHEMA) -> DataFrame:
    """One read over `folder/<symbol>.<fmt>`; the symbol is the file name. Symbols without a file have no rows; a file
    that cannot be read fails the read (see `load_report`), and so does a missing folder."""
    found = _files(spark, folder, symbols, fmt)
    if not found:
        df = spark.createDataFrame([], schema)
        return df if "symbol" in df.columns else df.withColumn("symbol", F.lit(None).cast("string"))
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").format(fmt).load(sorted(found.values()))
    return df.withColumn("symbol", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]+$", ""))


def load_report(spark: SparkSession, folder: str, symbols: list[str], fmt: str = "csv", schema: str | StructType = BAR_SCHEMA) -> DataFrame:
    """symbol, status (loaded, absent, failed), rows, error: each file read on its own, so that one damaged file is
    named and the others still count. One row per asked symbol."""
    found, report = _files(spark, folder, symbols, fmt), []
    for s in dict.fromkeys(symbols):
        if s not in found:
            report.append((s, "absent", 0, None))
            continue
        try:
            rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").format(fmt).load(found[s]).agg(F.count(F.struct("*"))).first()[0]
            report.append((s, "loaded", rows, None))
        except Exception as e:  # noqa: BLE001 - reported with the symbol
            report.append((s, "failed", 0, str(e).splitlines()[0][:500]))
    return spark.createDataFrame(report, "symbol string, status string, rows long, error string")


def standardize(df: DataFrame, time: str = "date") -> DataFrame:
    """Lower-case names with underscores, time column parsed to `ts`."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return out.withColumn("ts", F.to_timestamp(F.col(time.lower()))).drop(time.lower()) if time.lower() in out.columns else out


def daily_series(payloads: DataFrame, start: str, end: str, col: str = "payload") -> DataFrame:
    """`{"Time Series (Daily)": {date: {"1. open": "..", ...}}}` per symbol -> bars inside [start, end]."""
    m = F.from_json(col, "`Time Series (Daily)` MAP<STRING, MAP<STRING, STRING>>")["Time Series (Daily)"]
    x = payloads.select("symbol", F.explode(m).alias("day", "v"))
    v = lambda k, t: F.element_at("v", F.lit(k)).try_cast(t)
    out = x.select("symbol", F.to_timestamp("day").alias("ts"), v("1. open", "double").alias("open"), v("2. high", "double").alias("high"),
                   v("3. low", "double").alias("low"), v("4. close", "double").alias("close"), v("6. volume", "bigint").alias("volume"))
    return out.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def price_pairs(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """`{"prices": [[ms, price], ...]}` per symbol -> flat bars with volume 0."""
    x = payloads.select(F.upper("symbol").alias("symbol"), F.explode(F.from_json(col, "prices ARRAY<ARRAY<DOUBLE>>")["prices"]).alias("p"))
    px = F.col("p")[1]
    return x.select("symbol", F.timestamp_millis(F.col("p")[0].cast("long")).alias("ts"), *[px.alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("volume"))


def first_provider(frames: DataFrame) -> DataFrame:
    """Rows of the lowest `priority` that has any row for the symbol; one small aggregate joined back."""
    best = frames.groupBy("symbol").agg(F.min("priority").alias("priority"))
    return frames.join(best, ["symbol", "priority"])


def coin_id(symbol: Column) -> Column:
    out = F.lower(symbol)
    for k, v in COIN_IDS.items():
        out = F.when(F.upper(symbol) == k, F.lit(v)).otherwise(out)
    return out


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested records to columns named by their path."""
    cols = []

    def walk(fields, path):
        for f in fields:
            full = [*path, f.name]
            if isinstance(f.dataType, StructType):
                walk(f.dataType.fields, full)
            else:
                cols.append(F.col(".".join(f"`{p}`" for p in full)).alias(sep.join(full)))

    walk(df.schema.fields, [])
    return df.select(*cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN sorts above every number and poisons averages; missing values are null from here on."""
    return df.select(*[F.nullif(F.col(f.name), F.lit(float("nan")).cast(f.dataType)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])
