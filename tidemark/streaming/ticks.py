"""Event-time tick streams: bars, views, state, alerts, sinks."""
from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.plans.ordered import stepwise
from tidemark.plans.ranges import in_ranges, scan_before
from tidemark.plans.session import ensure_checkpoint_dir, utc_schema
from tidemark.streaming.rules import VOL_F, VOL_Q, VOL_R, VOL_START

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tick_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "1 minute", min_ticks: int = 1, tie=("ts", "event_id")) -> DataFrame:
    """One final bar per symbol and window: OHLC, volume, VWAP, trade count. Late rows beyond `delay` are dropped (the
    query's progress counts them as `numRowsDroppedByWatermark`); `min_ticks` leaves thinner bars out."""
    at = F.struct(*tie)
    vol = F.sum("volume")
    g = (ticks.withWatermark("ts", delay).withColumn("_at", at).groupBy(F.window("ts", width).alias("w"), "symbol")
         .agg(F.min_by("price", "_at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_at").alias("close"),
              vol.cast("double").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("_pv"), F.count(F.lit(1)).alias("num_trades")))
    vwap = F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(F.col("close"))
    return g.where(F.col("num_trades") >= min_ticks).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close",
                                                            "volume", vwap.alias("vwap"), "num_trades")


def sliding_view(ticks: DataFrame, width: str = "5 minutes", slide: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"), F.sum("volume").cast("double").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_price", "volume")


def throughput(ticks: DataFrame, width: str = "1 second", delay: str = "1 minute") -> DataFrame:
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("price").isNull()).alias("errors"))
    return g.select(F.col("w.start").alias("start"), "ticks", "errors")


def dedupe_ticks(ticks: DataFrame, delay: str = "10 minutes", key: str = "event_id") -> DataFrame:
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def batch_rule(df: DataFrame, keys: list[str], order: list[str], rule, keep: list[str]) -> DataFrame:
    """A rule over a finite table."""
    return stepwise(df, keys, order, rule.init, rule.advance, rule.inputs, keep, rule.outputs)


#: Rows of a key sorted at once, and rows of a sorted run that are read back at once.
_RUN, _PIECE = 200_000, 5_000


class _Rows:
    """Rows of one key in a micro-batch, column by column: numbers and times as arrays, other values as codes of a dictionary.
    Only a piece of them at a time becomes Python values. More than `_RUN` rows wait as sorted runs in a local temp file and
    are merged piece by piece, so memory holds a run, then pieces that overlap in the order, and the different values of a
    dictionary. Rows are sorted by `order`, nulls last; rows alike in it stay as they came."""

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order, self.words, self.whole = columns, order, {}, set()
        self.parts, self.held, self.seen, self.file, self.index = {c: [] for c in columns}, 0, 0, None, []

    def add(self, f: pd.DataFrame) -> None:
        for c in self.columns:
            x = f[c]
            if isinstance(x.dtype, np.dtype) and x.dtype != object:
                self.parts[c].append(x.to_numpy().copy())  # not a view that keeps the batch
                continue
            if c not in self.whole:
                try:
                    code, found = pd.factorize(x)
                    words = self.words.setdefault(c, {})
                    self.parts[c].append(np.array([*[words.setdefault(v, len(words)) for v in found], -1], dtype=np.int32)[code])
                    continue
                except TypeError:  # lists and structs have no hash
                    self.whole.add(c)
            self.parts[c].append(x.to_numpy(dtype=object))
        self.held += len(f)
        if self.held >= _RUN:
            self._spill()

    def _lists(self) -> dict[str, np.ndarray]:
        """Words by code; the last is the null."""
        lists = {}
        for c, known in self.words.items():
            lists[c] = np.empty(len(known) + 1, dtype=object)
            lists[c][:-1] = list(known)
        return lists

    def _rank(self, c: str, x: np.ndarray) -> np.ndarray:
        if c not in self.words:
            return x
        words, code = self._lists()[c], np.unique(x)
        place = np.full(len(words), len(words))
        place[sorted((i for i in code.tolist() if i >= 0), key=lambda i: words[i])] = np.arange((code >= 0).sum())
        return place[x]

    def _sorted(self, columns: dict) -> dict:
        at = np.lexsort([columns[None], *[self._rank(c, columns[c]) for c in reversed(self.order)]])
        return {c: x[at] for c, x in columns.items()}

    def _rows(self) -> dict:
        """The rows held, sorted, with their places in the order of arrival under None."""
        columns = {c: np.concatenate(x) if x else np.zeros(0) for c, x in self.parts.items()}
        columns[None] = np.arange(self.seen, self.seen + self.held)
        self.parts, self.seen, self.held = {c: [] for c in self.columns}, self.seen + self.held, 0
        return self._sorted(columns)

    def _key(self, columns: dict, i: int, words: dict[str, np.ndarray]) -> tuple:
        def part(c: str) -> tuple:
            v = columns[c][i]
            if c in words:
                return (0, words[c][v]) if v >= 0 else (1, 0)
            return (0, v) if v == v else (1, 0)

        return (*[part(c) for c in self.order], int(columns[None][i]))

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="tidemark-rows-")
        rows, words = self._rows(), self._lists()
        for lo in range(0, len(rows[None]), _PIECE):
            part = {c: x[lo:lo + _PIECE] for c, x in rows.items()}
            self.index.append((self._key(part, 0, words), self.file.tell()))
            pickle.dump(part, self.file, 5)

    def _merged(self) -> Iterator[dict]:
        """The sorted runs as one; a piece is read when the rows before its first have gone."""
        words, pool, left = self._lists(), [], 0
        self.index.sort()
        for k, (_, at) in enumerate(self.index):
            self.file.seek(at)
            pool.append(pickle.load(self.file))
            last = k + 1 == len(self.index)
            if last or sum(len(x[None]) for x in pool) > max(3 * _PIECE, 2 * left):
                rows = self._sorted({c: np.concatenate([x[c] for x in pool]) for c in pool[0]})
                n = len(rows[None])
                cut = n if last else bisect_left(range(n), self.index[k + 1][0], key=lambda i: self._key(rows, i, words))
                yield {c: x[:cut] for c, x in rows.items()}
                left, pool = n - cut, [{c: x[cut:].copy() for c, x in rows.items()}]
        self.file.close()

    def pieces(self, size: int = 10_000) -> Iterator[pd.DataFrame]:
        """The rows in order; ends with the rows given up."""
        if self.file is None:
            if not self.held:
                return
            runs = iter((self._rows(),))
        else:
            if self.held:
                self._spill()
            runs = self._merged()
        words = self._lists()
        for rows in runs:
            for lo in range(0, len(rows[None]), size):
                part = {c: rows[c][lo:lo + size] for c in self.columns}
                yield pd.DataFrame({c: words[c][x] if c in words else x for c, x in part.items()})


class _RuleProcessor(StatefulProcessor):
    """Runs a rule over the rows of one key, micro-batch by micro-batch; state expires after `ttl` ms of silence."""

    def __init__(self, keys, kinds, order, rule, keep, names, ttl):
        self.keys, self.order, self.rule, self.keep, self.names, self.ttl = keys, order, rule, keep, names, ttl

    def init(self, handle):
        self.state = handle.getValueState("rule", "blob binary", **({"ttlDurationMs": self.ttl} if self.ttl else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.keys, key))  # the same in every row
        got_rows = _Rows([c for c in dict.fromkeys([*self.order, *self.rule.inputs, *self.keep]) if c not in held or c in self.order], self.order)
        for f in rows:
            got_rows.add(f)
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.rule.init()
        for f in got_rows.pieces():
            f = f.assign(**{c: v for c, v in held.items() if c not in f and (c in self.keep or c in self.rule.inputs)})
            out = []
            for row in zip(*[f[c].tolist() for c in self.rule.inputs]):
                state, got = self.rule.advance(state, *row)
                out.append(got)
            result = f[self.keep].copy()
            for i, n in enumerate(self.names):
                result[n] = [r[i] for r in out]
            yield result
        self.state.update((pickle.dumps(state),))

    def close(self):
        pass


def stream_rule(df: DataFrame, keys: list[str], order: list[str], rule, keep: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The same rule over a stream, state per key in RocksDB. `ttl_ms` expires the state of silent keys on
    the wall clock; that needs a continuously running trigger, since it keeps waking up on its own."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [rule.outputs])
    names = [p.split()[0] for p in rule.outputs.split(", ")]
    proc = _RuleProcessor(keys, kinds, order, rule, keep, names, ttl_ms)
    return df.groupBy(*keys).transformWithStateInPandas(proc, outputStructType=schema, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


def price_alerts(ticks: DataFrame, alerts: DataFrame, runner: Callable = stream_rule) -> DataFrame:
    """One-shot alerts: ticks meet the alerts of their symbol, and each alert fires at its first crossing.
    alerts: symbol, alert_id, target, side (above or below, inclusive)."""
    hit = F.when(F.col("side") == "above", F.col("price") >= F.col("target")).otherwise(F.col("price") <= F.col("target"))
    x = ticks.join(alerts, "symbol").withColumn("crossed", hit).where("crossed")
    from tidemark.streaming.rules import FireOnce
    return runner(x, ["alert_id"], ["ts"], FireOnce(), ["alert_id", "symbol", "ts", "target", "price"]).where("fired").drop("fired")


def position_metrics(ticks: DataFrame, positions: DataFrame, volatility: float = 0.2, runner: Callable = stream_rule) -> DataFrame:
    """Market value, gain against the previous tick, VaR contribution for each holding of the ticked symbol."""
    from tidemark.streaming.rules import PreviousPrice
    x = runner(ticks, ["symbol"], ["ts"], PreviousPrice(), ["symbol", "ts", "price"]).join(positions, "symbol")
    mv = F.col("quantity") * F.col("price")
    return x.select("portfolio", "symbol", "ts", mv.alias("market_value"), (F.col("quantity") * (F.col("price") - F.coalesce("prev", "price"))).alias("unrealized"),
                    (F.abs(mv) * volatility * 1.65).alias("var_contribution"))


def portfolio_ticks(ticks: DataFrame, positions: DataFrame, bucket: Column) -> DataFrame:
    return ticks.join(positions, "symbol").select("portfolio", "symbol", "ts", "quantity", "price", bucket.cast("string").alias("bucket"))


def risk_alerts(risk: DataFrame) -> DataFrame:
    """VaR over 5% of value, drawdown over 10%, concentration over 0.4, volatility over 50%."""
    names = F.array_compact(F.array(
        F.when(F.abs("var_95") > 0.05 * F.col("value"), F.lit("var_95")), F.when(F.col("drawdown") > 0.10, F.lit("drawdown")),
        F.when(F.col("concentration") > 0.4, F.lit("concentration")), F.when(F.col("volatility") > 0.5, F.lit("volatility"))))
    return risk.withColumn("alert", F.explode(names))


def parse_trades(raw: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(ticks, rejects): only type 'trade' with symbol, millisecond time and price; the rest is kept apart to be counted."""
    p = raw.withColumn("_m", F.from_json(col, "type STRING, s STRING, t BIGINT, p DOUBLE, v DOUBLE"))
    ok = (F.col("_m.type") == "trade") & F.col("_m.s").isNotNull() & F.col("_m.t").isNotNull() & F.col("_m.p").isNotNull()
    good = p.where(ok).select(F.col("_m.s").alias("symbol"), F.timestamp_millis("_m.t").alias("ts"), F.col("_m.p").alias("price"), F.col("_m.v").alias("volume"))
    return good, p.where(~F.coalesce(ok, F.lit(False))).drop("_m")


def parse_quotes(raw: DataFrame, col: str = "payload", arrival: Column | None = None) -> DataFrame:
    """Quote payloads; the arrival time is the event time. Missing price or volume count as 0."""
    m = F.from_json(col, "last_price STRING, volume_24h STRING, bid DOUBLE, ask DOUBLE")
    return raw.withColumn("_m", m).where("_m is not null").select(
        "symbol", (F.current_timestamp() if arrival is None else arrival).alias("ts"), F.coalesce(F.col("_m.last_price").try_cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("_m.volume_24h").try_cast("double"), F.lit(0.0)).alias("volume"), F.col("_m.bid").alias("bid"), F.col("_m.ask").alias("ask"))


def file_stream(spark: SparkSession, root: str, name: str, files_per_trigger: int | None = 1) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream of files with UTC event time.

    `files_per_trigger` bounds a micro-batch (None: all that is there). A table without files is an error, not an
    empty stream.
    """
    schema = utc_schema(spark.read.parquet(f"{root}/{name}.parquet").schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    if not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path)):
        raise ValueError(f"no Parquet file in {root}/{name}.parquet")
    return reader.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{kind}-{uuid.uuid4().hex}")


def drain(stream: DataFrame) -> DataFrame:
    """Process what is available, appending to Parquet in the shared folder, and read the result."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-state").option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def process_batches(stream: DataFrame, processors: dict[str, Callable[[DataFrame], DataFrame]], out: str) -> dict[str, int]:
    """Each micro-batch goes to every processor; results append per processor under the batch id, so a retried batch
    overwrites itself. A processor that fails does not stop the others: its batch goes to `<out>/_rejects/<name>` with
    the error, to be run again from there. A batch is committed only when results or rejects of all are written.
    Returns the number of rejected batches that `<out>` holds, by processor."""
    def each(df: DataFrame, batch_id: int) -> None:
        for name, fn in processors.items():
            try:
                fn(df).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            except Exception as e:  # noqa: BLE001 - kept with its rows
                df.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:2000])).write.mode("overwrite").parquet(f"{out}/_rejects/{name}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", out + "/_state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    counts = {}
    for name in processors:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_rejects/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        counts[name] = len(fs.listStatus(path)) if fs.exists(path) else 0
    return counts


def rejected(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows, batch id and error of a processor's rejected batches."""
    return spark.read.option("basePath", f"{out}/_rejects/{name}").parquet(f"{out}/_rejects/{name}/batch=*")


def filtered_volatility(rets: DataFrame, keys=("symbol",), order=("ts",)) -> DataFrame:
    """The volatility filter over a whole table, as a scan: (keys, order, volatility).

    The noise is constant, so the gain depends on the number of rows seen only and settles; given it, a row maps the
    state x to a x + b. A hot symbol lies in many tasks. Rows without a return are left out; `order` must be total.
    """
    keys, order = list(keys), list(order)
    gains, p = [], VOL_START[1]
    while len(gains) < 2 or gains[-1] != gains[-2]:
        p = VOL_F * VOL_F * p + VOL_Q
        gains.append(p / (p + VOL_R))
        p = (1 - gains[-1]) ** 2 * p + gains[-1] ** 2 * VOL_R
        if len(gains) == 1000:
            break
    x = in_ranges(rets.where("ret is not null").select(*keys, *order, "ret"), keys, order)
    x = scan_before(x, keys, {"_n": ("affine", F.lit(1.0), F.lit(1.0), 0.0)})
    k = F.element_at(F.array(*map(F.lit, gains)), F.least(F.col("_n") + 1, F.lit(float(len(gains)))).cast("int"))
    x = x.withColumns({"_a": (1 - k) * VOL_F, "_b": k * 0.5 * F.log(F.greatest(F.col("ret") * F.col("ret"), F.lit(1e-8)))})
    x = scan_before(x, keys, {"_x": ("affine", F.col("_a"), F.col("_b"), VOL_START[0])})
    return x.select(*keys, *order, F.exp(F.col("_a") * F.col("_x") + F.col("_b")).alias("volatility"))


def smooth(bars: DataFrame) -> DataFrame:
    """Fixed-interval smoother of the trend model: forward filter, backward pass. A group is one bar series,
    bounded by the calendar."""
    import numpy as np
    from tidemark.streaming.rules import TREND_F, TREND_Q, TrendFilter

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts")
        rule, a, q = TrendFilter(), np.array(TREND_F), np.diag(TREND_Q)
        state, xs, ps = rule.init(), [], []
        for px in f["close"]:
            state, _ = rule.advance(state, px)
            xs.append(state[0])
            ps.append(state[1])
        sx, sp = [None] * len(xs), [None] * len(xs)
        sx[-1], sp[-1] = xs[-1], ps[-1]
        for k in range(len(xs) - 2, -1, -1):
            pp = a @ ps[k] @ a.T + q
            g = ps[k] @ a.T @ np.linalg.inv(pp)
            sx[k], sp[k] = xs[k] + g @ (sx[k + 1] - a @ xs[k]), ps[k] + g @ (sp[k + 1] - pp) @ g.T
        m = np.array(sx)
        return pd.DataFrame({"symbol": f["symbol"], "ts": f["ts"], "level": m[:, 0], "trend": m[:, 1], "variance": [p[0, 0] for p in sp]})

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, level double, trend double, variance double")
