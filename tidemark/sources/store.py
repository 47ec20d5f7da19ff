"""Versioned tables: immutable data folders, one manifest per version, readers pinned to a version.

    <path>/data/batch=<id>/<partition columns>/part-*.parquet
    <path>/manifest/<version>.json        live partition folders and the schema

A writer adds a data folder and then its manifest, by a rename that fails where the version exists. Whoever dies before
that leaves the version before it untouched; two writers of one version can't both win. No file is ever written over,
so readers of an older version go on until `vacuum` drops it. A manifest has one entry per partition and folder:
its length follows the calendar, not the rows; `compact` brings it back to one folder a partition.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer has committed the version; run the operation again."""


class VersionedStore:
    """A table below `path`, partitioned by `partition` (columns of the rows, null allowed), sorted by `sort` in its files."""

    def __init__(self, spark: SparkSession, path: str, partition: Sequence[str], sort: Sequence[str] = ()):
        self.spark, self.path, self.partition, self.sort = spark, path, list(partition), list(sort)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json") and n[0].isdigit()]

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "entries": [], "schema": None}
        if version not in known:
            raise ValueError(f"version {version} is not in {self.path}")
        text = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, base: dict, entries: list[str], schema: StructType) -> int:
        version = base["version"] + 1
        body = json.dumps({"version": version, "entries": sorted(entries), "schema": schema.jsonValue()})
        draft, final = self._at(f"{self.path}/manifest/_{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest/{version:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        no_overwrite = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(),
                                                    self.spark._jsc.hadoopConfiguration()).rename(draft, final, no_overwrite)
        except Exception as e:  # py4j wraps what the rename raised
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise VersionConflict(f"version {version} of {self.path} exists") from e
            raise
        return version

    def _folders(self, root: str) -> list[str]:
        """Partition folders below `root`, relative to it."""
        found = [""]
        for c in self.partition:
            found = [f"{p}/{n}" if p else n for p in found for n in self._names(f"{root}/{p}") if n.startswith(f"{c}=")]
        return found

    def _write(self, df: DataFrame, root: str) -> list[str]:
        """Rows as partition folders below `root`. Rebalancing joins small tasks and splits a hot partition."""
        rows = df.hint("rebalance", *self.partition)
        if self.sort:
            rows = rows.sortWithinPartitions(*self.partition, *self.sort)
        rows.write.partitionBy(*self.partition).parquet(root)
        return self._folders(root)

    def _load(self, base: str, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)

    def _schema(self, df: DataFrame, base: dict) -> StructType:
        """Columns of the rows, partition columns last, all nullable; a later load must bring the same ones."""
        absent = [c for c in self.partition if c not in df.columns]
        if absent:
            raise ValueError(f"missing partition columns {absent}")
        fields = [df.schema[c] for c in df.columns if c not in self.partition] + [df.schema[c] for c in self.partition]
        schema = StructType()
        for f in fields:
            schema.add(f.name, f.dataType, True)
        if base["schema"] and StructType.fromJson(base["schema"]) != schema:
            raise ValueError(f"columns differ from the store's: {schema.simpleString()}")
        return schema

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version (None: the latest one, fixed now); filters on partition columns prune folders."""
        m = self._manifest(version)
        if m["schema"] is None:
            raise ValueError(f"no version in {self.path}")
        return self._load(f"{self.path}/data", m["entries"], StructType.fromJson(m["schema"]))

    def append(self, df: DataFrame) -> int:
        """Rows beside those of the latest version; returns the new version. Repeated rows stay."""
        base = self._manifest(None)
        schema, batch = self._schema(df, base), f"batch={uuid.uuid4().hex}"
        added = self._write(df.select(*schema.names), f"{self.path}/data/{batch}")
        return self._commit(base, base["entries"] + [f"{batch}/{f}" for f in added], schema)

    def upsert(self, df: DataFrame, keys: Sequence[str], newest: str | None = None) -> int:
        """Incoming rows replace those of the same keys in their partition (null keys match each other), others stay.

        Of incoming rows for one key the one with the largest `newest` wins; without that column a repeated key is an
        error. Partition columns belong to the key. Only touched partitions are read and written again.
        """
        keys = list(dict.fromkeys([*keys, *self.partition]))
        base = self._manifest(None)
        schema, batch, staged = self._schema(df, base), f"batch={uuid.uuid4().hex}", f"{self.path}/staging/{uuid.uuid4().hex}"
        rest = [c for c in schema.names if c not in keys]
        rows = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(newest) if newest else F.lit(1)).alias("_r"), F.count(F.lit(1)).alias("_n"))
        if not newest:
            rows = rows.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(
                F.raise_error(F.concat(F.lit("repeated key; name the column that decides: "), F.to_json(F.struct(*keys)))).cast(rows.schema["_r"].dataType)))
        rows = rows.select(*keys, "_r.*").select(*schema.names)
        try:
            touched = set(self._write(rows, staged))
            live = [e for e in base["entries"] if e.split("/", 1)[1] in touched]
            new = self._load(staged, sorted(touched), schema)
            if live:
                old, k = self._load(f"{self.path}/data", live, schema), new.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
                same = [old[c].eqNullSafe(k[f"_k_{c}"]) for c in keys]
                new = new.unionByName(old.join(k, same, "left_anti"))
            added = self._write(new, f"{self.path}/data/{batch}") if touched else []
            keep = [e for e in base["entries"] if e.split("/", 1)[1] not in touched]
            return self._commit(base, keep + [f"{batch}/{f}" for f in added], schema)
        finally:
            self._fs.delete(self._at(staged), True)

    def compact(self, folders: int = 1) -> int | None:
        """Partitions spread over more than `folders` folders become one; None where there is no such partition."""
        base, held = self._manifest(None), {}
        for e in base["entries"]:
            held.setdefault(e.split("/", 1)[1], []).append(e)
        many = {p: es for p, es in held.items() if len(es) > folders}
        if not many:
            return None
        schema, batch = StructType.fromJson(base["schema"]), f"batch={uuid.uuid4().hex}"
        added = self._write(self._load(f"{self.path}/data", sorted(sum(many.values(), [])), schema), f"{self.path}/data/{batch}")
        return self._commit(base, [e for p, es in held.items() if p not in many for e in es] + [f"{batch}/{f}" for f in added], schema)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Drop all but the last `keep` versions and the folders that only they hold; returns the dropped versions.
        Folders of writers at work are in no manifest and stay."""
        if keep < 1:
            raise ValueError("keep at least one version")
        known = self.versions()
        drop, stay = known[:-keep], known[-keep:]
        live = {e for v in stay for e in self._manifest(v)["entries"]}
        dead = {e for v in drop for e in self._manifest(v)["entries"]} - live
        for v in drop:
            self._fs.delete(self._at(f"{self.path}/manifest/{v:012d}.json"), False)
        for e in sorted(dead):
            self._fs.delete(self._at(f"{self.path}/data/{e}"), True)
        return drop


def market_store(spark: SparkSession, path: str) -> VersionedStore:
    """Bars by month; rows need `year` and `month` (see `writers.month_columns`)."""
    return VersionedStore(spark, path, ["year", "month"], ["symbol", "ts"])
