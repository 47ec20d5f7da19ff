"""Joins of the analytics model: alignment, lookups with defaults, as-of, calendars."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType, TimestampNTZType, TimestampType

from tidemark.plans.ordered import row_index, running
from tidemark.plans.session import stored


def align_complete(rets: DataFrame) -> DataFrame:
    """Keep the dates on which every symbol has a return (long form of an inner join of all series)."""
    known = rets.where("ret is not null")
    n = known.agg(F.countDistinct("symbol").alias("_n"))
    full = known.groupBy("ts").agg(F.countDistinct("symbol").alias("_k")).join(F.broadcast(n)).where("_k = _n").select("ts")
    return known.join(full, "ts")


def align_from_end(rets: DataFrame, split=False) -> DataFrame:
    """Position from the end (1 = last); keep the last min-length rows of each symbol."""
    sized = rets.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    shortest = sized.agg(F.min("_n").alias("_min"))
    pos = row_index(rets, ["symbol"], ["ts"], split=split).join(sized, "symbol")
    pos = pos.withColumn("back", F.col("_n") - F.col("_rn")).join(F.broadcast(shortest))
    return pos.where("back <= _min").drop("_rn", "_n", "_min")


def with_benchmark(rets: DataFrame, bench: DataFrame) -> DataFrame:
    return rets.join(bench, "ts")


def lookup(df: DataFrame, table: DataFrame, key: str, values: dict[str, float]) -> DataFrame:
    """Left join with a default per looked-up column."""
    return df.join(table, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def scenario_positions(pos: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each position meets each scenario. The scenario names form one short array, so this is a
    generator over rows and not a cartesian product."""
    names = scenarios.select("scenario").distinct().agg(F.sort_array(F.collect_set("scenario")).alias("_names"))
    return pos.join(F.broadcast(names)).withColumn("scenario", F.explode("_names")).drop("_names")


def asof(left: DataFrame, right: DataFrame, keys: list[str], value: Column, order: list[str], strict: bool = True,
         split: bool | None = None, out: str = "asof") -> DataFrame:
    """Latest earlier `right` value for each `left` row: union, then running last non-null.

    `order` must be total and exist on both sides. `strict=True` needs an earlier `order[0]`; rows
    that share it are resolved by sorting left rows first.
    """
    side = "_side"
    both = (left.withColumn(side, F.lit(0)).withColumn("_v", F.lit(None).cast(right.select(value).schema[0].dataType))
            .unionByName(right.withColumn("_v", value).withColumn(side, F.lit(1)), allowMissingColumns=True))
    seq = [order[0], side, *order[1:]] if strict else list(order)
    both = running(both, keys, seq, {out: ("last", F.col("_v"))}, split=split)
    return both.where(F.col(side) == 0).select(*left.columns, out)


def business_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Weekdays between each symbol's first and last date."""
    span = df.groupBy("symbol").agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    return days.where(F.weekday("day") < 5)


def _missing(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(symbol, miss): the weekdays without a row between each symbol's first and last, as one sorted array, bounded by the
    calendar. Only present days are shuffled; a null symbol equals none, as in a join."""
    day = F.to_date(ts)
    have = df.groupBy("symbol").agg(F.min(day).alias("a"), F.max(day).alias("b"), F.collect_set(F.when(F.col("symbol").isNotNull(), day)).alias("have"))
    return have.select("symbol", F.array_except(F.filter(F.sequence("a", "b"), lambda x: F.weekday(x) < 5), "have").alias("miss"))


def missing_business_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    return _missing(df, ts).select("symbol", F.explode("miss").alias("day"))


def missing_day_gaps(df: DataFrame, min_days: int = 2, business: bool = False) -> DataFrame:
    """Runs of missing days kept when end - start >= min_days. By default only calendar neighbours
    join, so a weekend breaks a run; `business=True` lets Friday and Monday touch. Runs are cut inside
    a symbol's array: its days never become rows."""
    def key(day: Column) -> Column:
        n = F.date_diff(day, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.weekday(day) if business else n

    miss = F.col("miss")
    begins = F.filter(miss, lambda x, i: (i == 0) | (key(x) - key(F.get(miss, i - 1)) != 1))
    ends = F.filter(miss, lambda x, i: (i == F.size(miss) - 1) | (key(F.get(miss, i + 1)) - key(x) != 1))
    runs = F.filter(F.arrays_zip(begins.alias("start"), ends.alias("end")), lambda r: F.date_diff(r["end"], r["start"]) >= min_days)
    return _missing(df).select("symbol", F.inline(runs).alias("start", "end"))


#: Products of a weight and a return that a task holds at once.
_TERMS = 1 << 21


class _Returns:
    """Returns of one block: the entries of a symbol lie side by side, dates are codes. Entries are pairs (ts, ret), or returns
    with their `days` in a list of their own, which takes half the room."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.symbols, lists = rows["symbol"].combine_chunks(), rows["entries"].combine_chunks()
        apart = "days" in rows.column_names
        stop = np.cumsum(lists.value_lengths().to_numpy())
        self.size = np.diff(stop, prepend=0)
        self.start = stop - self.size
        ts, ret = (rows["days"].combine_chunks().flatten(), lists.flatten()) if apart else lists.flatten().flatten()
        coded = ts.dictionary_encode(null_encoding="encode")
        self.days, self.day, self.ret = coded.dictionary, coded.indices.to_numpy().astype(np.int64), ret.to_numpy()

    def sums(self, own: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of `n` portfolios (`own`) on symbols (`at`) -> the weighted sums per portfolio and date, and whether there is a term."""
        size = self.size[at]
        i = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(own * len(self.days), size) + self.day[i]
        shape = (n, len(self.days))
        return (np.bincount(cell, np.repeat(weight, size) * self.ret[i], n * len(self.days)).reshape(shape), np.bincount(cell, minlength=n * len(self.days)).reshape(shape) > 0)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each with its returns first and then its weights by portfolio -> portfolio, ts, ret. Weights stream; a portfolio
    that goes on in the next piece hands on one row of sums."""
    block, parts, rets, held = None, [], None, None

    def rows(portfolios: pa.Array, sums: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(known)
        return pa.RecordBatch.from_arrays([portfolios.take(pa.array(i)), rets.days.take(pa.array(j)), pa.array(sums[i, j])], names=["portfolio", "ts", "ret"])

    for batch in batches:
        mark = np.stack([batch.column(c).to_numpy() for c in ("_p", "_d", "_side")])
        cuts = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if block != (own := tuple(mark[:2, lo].tolist())):
                if held:
                    yield rows(*held)
                block, parts, rets, held = own, [], None, None
            if mark[2, lo] == 0:
                parts.append(part.select([c for c in ("symbol", "days", "entries") if c in part.schema.names]))
                continue
            if rets is None:
                if not parts:  # none of the block's symbols has a return
                    continue
                rets, parts = _Returns(parts), []
            at = pc.index_in(part["symbol"], value_set=rets.symbols)
            part, at = part.filter(at.is_valid()), at.drop_null().to_numpy()
            if not len(at):
                continue
            coded = part["portfolio"].dictionary_encode(null_encoding="encode")  # sorted, so codes ascend
            code, weight = coded.indices.to_numpy().astype(np.int64), part["weight"].to_numpy()
            upto, most = np.cumsum(rets.size[at]), max(1, _TERMS // len(rets.days))
            a = 0
            while a < len(at):
                b = max(a + 1, min(np.searchsorted(upto, upto[a] + _TERMS, side="right"), np.searchsorted(code, code[a] + most)))
                names = coded.dictionary.slice(code[a], code[b - 1] - code[a] + 1)
                sums, known = rets.sums(code[a:b] - code[a], at[a:b], weight[a:b], len(names))
                if held and held[0].equals(names.slice(0, 1)):
                    sums[0] += held[1][0]
                    known[0] |= held[2][0]
                elif held:
                    yield rows(*held)
                if len(names) > 1:
                    yield rows(names.slice(0, len(names) - 1), sums[:-1], known[:-1])
                held, a = (names.slice(len(names) - 1), sums[-1:].copy(), known[-1:].copy()), b
    if held:
        yield rows(*held)


def _met(r: DataFrame, w: DataFrame, down: int) -> tuple[DataFrame, DataFrame]:
    """Returns and weights as rows of blocks (_p, _d): a symbol's returns go to the blocks of portfolios that hold it."""
    day, every = F.pmod(F.xxhash64("ts"), F.lit(down)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    packed = r.groupBy("symbol", day.alias("_d")).agg(F.collect_list(F.struct("ts", "ret")).alias("_e")).select("symbol", "_d", F.col("_e.ts").alias("days"), F.col("_e.ret").alias("entries"))
    held = w.select("_p", "symbol").distinct().withColumn("_d", every)
    none = {c: F.array().cast(packed.schema[c].dataType).alias(c) for c in ("days", "entries")}  # empty: a null list makes Arrow's writer fill a whole batch anew for each row
    left = w.select("_p", every.alias("_d"), F.lit(1).alias("_side"), "portfolio", "symbol", "weight", none["days"], none["entries"])
    right = held.join(packed, ["symbol", "_d"]).select(  # on both, as `packed` is dealt: it is not shuffled again
        "_p", "_d", F.lit(0).alias("_side"), F.lit(None).cast(w.schema["portfolio"].dataType).alias("portfolio"), "symbol", F.lit(None).cast("double").alias("weight"), "days", "entries")
    return right, left


def _layout(r: DataFrame, w: DataFrame, across: int, cells: int, n_dates: int, dates: int, tasks: int) -> tuple[int, int]:
    """How many neighbouring ranges of portfolios become one, and into how many blocks of dates: the least rows to send
    (returns once per range that holds them, weights once per block of dates) with as many blocks as tasks, where there are so many."""
    steps = [1 << k for k in range(max(across - 1, 0).bit_length() + 1)]
    counts = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    held = w.groupBy("_p", "symbol").agg(F.count(F.lit(1)).alias("k")).join(counts, "symbol")
    g = held.select(F.explode(F.array(*map(F.lit, steps))).alias("g"), "_p", "symbol", "n", "k").withColumn("_p", F.floor(F.col("_p") / F.col("g")))
    each = g.groupBy("g", "_p", "symbol").agg(F.first("n").alias("n"), F.sum("k").alias("k")).groupBy("g", "_p").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    found = each.groupBy("g").agg(F.sum("n").alias("sent"), F.max("n").alias("most"), F.sum("k").alias("weights"), F.count(F.lit(1)).alias("ranges")).collect()
    options = []
    for x in found:
        down = max(1, min(n_dates, max(-(-x["most"] // cells), -(-n_dates // dates))))
        options.append((max(0, tasks - x["ranges"] * down), x["sent"] + x["weights"] * down, x["g"], down))
    return min(options)[2:] if options else (1, 1)


def portfolio_returns(rets: DataFrame, weights: DataFrame, cells: int = 1 << 22, portfolios: int = 16_384, dates: int = 4096) -> DataFrame:
    """Weighted sum of aligned returns: (portfolio, ts, ret), for dates on which a held symbol has a return.

    A product of two sparse matrices, portfolio x symbol and symbol x date. Ranges of at most about `portfolios` portfolios
    meet blocks of at most about `dates` dates, fewer where a range's symbols have more than `cells` returns. A task holds the
    returns of a block, some tens of megabytes whatever the data; the weights stream past, portfolio by portfolio. The returns
    of a symbol are sent once per range of portfolios that holds it and a weight once per block of dates; where ranges hold
    much the same symbols, neighbours become one, as far as there are blocks enough for all cores. No (weight, return)
    pair ever becomes a row, and each result row is made in one place. Null weights and returns are absent ones, as are null
    symbols; repeated rows add up. The two inputs are written once, as Parquet, and counted when the plan is built.
    """
    spark = rets.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    r = stored(rets.where("ret is not null and symbol is not null").groupBy("symbol", "ts").agg(F.sum(F.col("ret").cast("double")).alias("ret")))
    known = weights.where("weight is not null and symbol is not null").select("portfolio", "symbol", F.col("weight").cast("double").alias("weight"))

    def ranged(rows: DataFrame, across: int) -> DataFrame:
        return stored(rows.repartitionByRange(across, "portfolio").withColumn("_p", F.spark_partition_id()).sortWithinPartitions("portfolio", "symbol"))

    across = n
    w = ranged(known, across)
    n_portfolios = w.agg(F.approx_count_distinct("portfolio")).first()[0]
    if n_portfolios > across * portfolios:
        across = -(-n_portfolios // portfolios)
        w = ranged(w.drop("_p"), across)
    kind = r.schema["ts"].dataType
    timed = isinstance(kind, (TimestampType, TimestampNTZType))
    midnights = F.every(F.col("ts").eqNullSafe(F.col("ts").cast("date").cast(kind))) if timed else F.lit(False)
    n_dates, daily = r.agg(F.approx_count_distinct("ts"), midnights).first()
    if daily:  # dates travel in half the room
        r = r.withColumn("ts", F.col("ts").cast("date"))
    g, down = _layout(r, w, across, cells, n_dates, dates, 2 * cores)
    w = w.withColumn("_p", F.floor(F.col("_p") / g).cast("int"))
    schema = StructType([w.schema["portfolio"], r.schema["ts"], StructField("ret", DoubleType())])
    right, left = _met(r, w, down)
    blocks = right.union(left).repartition(max(n, min(-(-across // g) * down, 10_000)), "_p", "_d").sortWithinPartitions("_p", "_d", "_side", "portfolio")
    return blocks.mapInArrow(_products, schema).withColumn("ts", F.col("ts").cast(kind))
