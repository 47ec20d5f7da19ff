"""Token totals by source, language and tokenizer version, kept up to date by signed batches."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.mixing import WORD
from tidemark.plans.session import ensure_checkpoint_dir

PIECE = r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]"
GROUP = ("source", "lang", "version")


def count_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def count_pieces(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PIECE)), F.lit(0)).cast("long")


class TokenRollup:
    """Additive totals in a folder that all executors reach.

    Every batch has an id and two parts: `ledger/batch=<id>` with a signed row per document and version (n documents,
    tokens), and `rollup/batch=<id>` with the same summed by group. A batch counts once its rollup part is complete
    (Spark's `_SUCCESS`), and a batch that counts is not applied again, so a retried or repeated delivery changes
    nothing; one that broke off is written over. Totals are sums over batches; no batch rewrites another.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> TokenRollup:
        """A new one below the session's checkpoint folder."""
        ensure_checkpoint_dir(spark)
        return cls(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token-rollup-{uuid.uuid4().hex}")

    def _part(self, kind: str, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch id has letters, digits, - and _ only")
        return f"{self.folder}/{kind}/batch={batch}"

    def committed(self, batch: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._part("rollup", batch) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> list[str]:
        """Ids of the batches that count."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rollup")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(b for b in names if self.committed(b))

    def _read(self, kind: str) -> DataFrame | None:
        paths = [self._part(kind, b) for b in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def _commit(self, batch: str, signed: DataFrame) -> bool:
        if self.committed(batch):
            return False
        signed.select("doc_id", *GROUP, F.col("n").cast("long").alias("n"), F.col("tokens").cast("long").alias("tokens")).write.mode("overwrite").parquet(self._part("ledger", batch))
        rows = self.spark.read.parquet(self._part("ledger", batch))
        rows.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(self._part("rollup", batch))
        return True

    def current(self) -> DataFrame | None:
        """What each document counts for now."""
        ledger = self._read("ledger")
        if ledger is None:
            return None
        return ledger.groupBy("doc_id", *GROUP).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n <> 0 or tokens <> 0")

    def insert(self, batch: str, rows: DataFrame) -> bool:
        """Rows (doc_id, source, lang, version, tokens) that are new; null tokens count as 0. False if applied before."""
        return self._commit(batch, rows.select("doc_id", *GROUP, F.lit(1).alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens")))

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Documents (doc_id) that go, with all versions; unknown, null and repeated ids change nothing more."""
        now = None if self.committed(batch) else self.current()
        if now is None:
            return False
        gone = now.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return self._commit(batch, gone.select("doc_id", *GROUP, (-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens")))

    def revise(self, batch: str, counts: DataFrame) -> bool:
        """New counts (doc_id, version, tokens) of known documents; of repeated ones the largest. Others are left out."""
        now = None if self.committed(batch) else self.current()
        if now is None:
            return False
        new = counts.groupBy("doc_id", "version").agg(F.max("tokens").alias("new"))
        return self._commit(batch, now.join(new, ["doc_id", "version"]).select("doc_id", *GROUP, F.lit(0).alias("n"), (F.coalesce("new", F.lit(0)) * F.col("n") - F.col("tokens")).alias("tokens")))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups that hold nothing any more are left out."""
        parts = self._read("rollup")
        if parts is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs long, n_tokens long")
        return parts.groupBy(*GROUP).agg(F.sum("n").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
