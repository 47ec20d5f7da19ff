"""Session helpers: reading the driver tables, UTC event time, lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType


def utc_schema(schema: StructType) -> StructType:
    """Zone-less timestamps as UTC instants: `withWatermark`, `unix_micros` and casts to numbers refuse
    TIMESTAMP_NTZ. Declaring the type at the scan, rather than casting after it, keeps time predicates
    on the raw column so that they reach Parquet."""
    return StructType([StructField(f.name, TimestampType(), f.nullable) if isinstance(f.dataType, TimestampNTZType) else f for f in schema.fields])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read `<root>/<name>.parquet` with UTC event time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{root}/{name}.parquet"
    return spark.read.schema(utc_schema(spark.read.parquet(path).schema)).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`; only a local master may fall back to a temp folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(shared)


def materialized(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to a folder of its own beside the checkpoints and continue from it. Shuffle files that were
    written on the way are removed with the write: a later step finds their room free."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path, name = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)
