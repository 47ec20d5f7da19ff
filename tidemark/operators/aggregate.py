"""Descriptive aggregates, matrices, contingency tables and chunked user functions."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.mathx import z_value
from tidemark.functions.scalar import equal_width_bin
from tidemark.plans.ordered import quantiles
from tidemark.plans.session import stored


def skew_unbiased(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_unbiased(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def describe(df: DataFrame, cols: list[str], keys=("symbol",)) -> DataFrame:
    """One row per key and column; every statistic comes from one partial aggregation."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"),
             "max": lambda c: F.max(c).cast("double"), "skew": skew_unbiased, "kurt": kurt_unbiased}
    wide = df.groupBy(*keys).agg(*[F.struct(*[f(c).alias(n) for n, f in stats.items()]).alias(c) for c in cols])
    tall = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])).alias("e"))
    return tall.select(*keys, "e.column", "e.s.*")


def terminal_summary(df: DataFrame, col: str, keys=("symbol",), split=None) -> DataFrame:
    basic = [F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")]
    probs = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    if split is False:  # bounded keys: one aggregation
        g = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(*basic, F.percentile(col, list(probs.values())).alias("_q"))
        return g.select(*keys, "mean", "std", "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    return df.groupBy(*keys).agg(*basic).join(quantiles(df, list(keys), col, probs, split=split), list(keys))


def missing_report(df: DataFrame, keys=("symbol",)) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    n = F.count(F.lit(1))
    anynull = F.lit(False)
    for c in cols:
        anynull = anynull | F.col(c).isNull()
    return df.groupBy(*keys).agg(*[(100.0 * F.count_if(F.col(c).isNull()) / n).alias(f"{c}_pct") for c in cols],
                                 (100.0 * F.count_if(anynull) / n).alias("any_pct"))


def integrity(df: DataFrame, keys=("symbol",)) -> DataFrame:
    neg = sum(F.count_if(F.col(c) <= 0) for c in ("open", "high", "low", "close"))
    rel = sum(F.count_if(c) for c in (
        F.col("high") < F.col("low"), F.col("high") < F.col("open"), F.col("high") < F.col("close"),
        F.col("low") > F.col("open"), F.col("low") > F.col("close")))
    return df.groupBy(*keys).agg(neg.alias("negative_prices"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
                                 rel.alias("price_inconsistencies"))


def outliers(df: DataFrame, col: str, method: str = "iqr", limit: float = 3.0, keys=("symbol",), split=None) -> DataFrame:
    """Number of outliers per key. A zero scale flags nothing."""
    keys = list(keys)
    rows = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias(col))
    x = F.col(col)
    own = Window.partitionBy(*keys)
    if method == "iqr" and split is False:
        j = rows.withColumn("_q", F.percentile(col, [0.25, 0.75]).over(own)).withColumns({"_a": F.col("_q")[0], "_b": F.col("_q")[1]})
        iqr = F.col("_b") - F.col("_a")
        bad = (x < F.col("_a") - 1.5 * iqr) | (x > F.col("_b") + 1.5 * iqr)
    elif method == "iqr":
        b = quantiles(rows, keys, col, {"_a": 0.25, "_b": 0.75}, split=split)
        iqr = F.col("_b") - F.col("_a")
        bad = (x < F.col("_a") - 1.5 * iqr) | (x > F.col("_b") + 1.5 * iqr)
        j = rows.join(b, keys)
    elif method == "zscore":
        b = rows.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
        j, bad = rows.join(b, keys), F.abs(F.try_divide(x - F.col("_m"), F.col("_s"))) > limit
    else:
        j = rows.join(quantiles(rows, keys, col, {"_med": 0.5}, split=split), keys).withColumn("_d", F.abs(x - F.col("_med")))
        j = j.join(quantiles(j, keys, "_d", {"_mad": 0.5}, split=split), keys)
        bad = F.try_divide(0.6745 * F.col("_d"), F.col("_mad")) > limit
    return j.groupBy(*keys).agg(F.count_if(bad).alias("n_outliers"))


def moments(df: DataFrame, col: str, keys=("symbol",)) -> DataFrame:
    """Mergeable moments in one partial/final aggregation; exact population skew and kurtosis."""
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.var_samp(col).alias("var"), F.skewness(col).alias("skew"),
        F.kurtosis(col).alias("kurt"), F.min(col).alias("min"), F.max(col).alias("max"), (F.max(col) - F.min(col)).alias("range"))


def normal_percentile(df: DataFrame, col: str, probs: list[float], keys=("symbol",)) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.avg(col) + z_value(p) * F.stddev_samp(col)).alias(f"p{round(p * 100)}") for p in probs])


#: Symbols on a side of a tile, dates of one product, and returns of a block that a task holds on each side.
_TILE, _DATES, _BLOCK_CELLS = 1024, 512, 1 << 21


class _PairBlock:
    """Pairwise-complete sums for every pair of columns of two symbol blocks. Holds the returns of the pair as (date, symbol,
    value) and sums them tile by tile when it ends; where there are too many of them and few symbols, they are added to six
    matrices of the blocks' sizes on the way."""

    SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def __init__(self, same: bool):
        self.names = [{}] if same else [{}, {}]
        self.same, self.day, self.t, self.held, self.sums = same, None, -1, 0, None
        self.parts = [[] for _ in self.names]

    def add(self, rows: pa.RecordBatch) -> None:
        if not rows.num_rows:
            return
        ts = rows["ts"]
        day = ts.to_numpy(zero_copy_only=False) if pa.types.is_timestamp(ts.type) else pc.cast(ts, pa.string()).to_numpy(zero_copy_only=False)
        new = np.append(self.day is None or day[0] != self.day, day[1:] != day[:-1])
        if new[0] and self.held > 2 * _BLOCK_CELLS and len(self.names[0]) * len(self.names[-1]) <= 4 * _TILE * _TILE:
            self._fold()
        t = self.t + np.cumsum(new)
        self.day, self.t = day[-1], int(t[-1])
        side = rows["side"].to_numpy()
        for k, names in enumerate(self.names):
            mask = np.ones(len(side), bool) if self.same else (side == 1) == (k == 1)
            own = rows.filter(pa.array(mask))
            if not own.num_rows:
                continue
            code = pc.list_flatten(own["s"]).dictionary_encode()
            place = np.array([names.setdefault(n, len(names)) for n in code.dictionary.to_pylist()], dtype=np.int32)
            at = np.repeat(t[mask].astype(np.int32), pc.list_value_length(own["v"]).to_numpy())
            self.parts[k].append((at, place[code.indices.to_numpy()], pc.list_flatten(own["v"]).to_numpy().copy()))
            self.held += len(at)

    def _sides(self) -> list[list[tuple]]:
        """The returns of each side, tile by tile and by date in a tile."""
        out = []
        for k, parts in enumerate(self.parts):
            tiles = -(-len(self.names[k]) // _TILE)
            at, place, value = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
            parts.clear()
            order = np.argsort(place // _TILE, kind="stable")  # dates ascend already
            at, place, value = at[order], place[order], value[order]
            cuts = np.searchsorted(place // _TILE, np.arange(tiles + 1))
            out.append([(at[lo:hi], place[lo:hi] % _TILE, value[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])])
        self.held = 0
        return out

    @staticmethod
    def _dense(tile: tuple, lo: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, place, value = tile
        a, b = np.searchsorted(at, (lo, lo + _DATES))
        m, known = np.zeros((min(_DATES, int(at[b - 1]) - lo + 1) if b > a else 0, n)), None
        known = np.zeros_like(m)
        m[at[a:b] - lo, place[a:b]], known[at[a:b] - lo, place[a:b]] = value[a:b], 1.0
        return m, known

    def _product(self, one: tuple, two: tuple, n: int, m: int) -> dict[str, np.ndarray]:
        """The six sums of two tiles of n and m symbols."""
        total = {k: np.zeros((n, m)) for k in self.SUMS}
        for lo in range(0, self.t + 1, _DATES):
            a, ka = self._dense(one, lo, n)
            b, kb = (a, ka) if one is two else self._dense(two, lo, m)
            d = min(len(a), len(b))
            if d:
                a, ka, b, kb = a[:d], ka[:d], b[:d], kb[:d]
                for k, x, y in (("n", ka, kb), ("sx", a, kb), ("sy", ka, b), ("sxx", a * a, kb), ("syy", ka, b * b), ("sxy", a, b)):
                    total[k] += x.T @ y
        return total

    def _tiles(self) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
        """The sums of the returns held, tile by tile; of a block with itself one of two mirrored tiles."""
        ni, nj = len(self.names[0]), len(self.names[-1])
        sides = self._sides()
        for i, one in enumerate(sides[0]):
            for j, two in enumerate(sides[-1]):
                if not self.same or i <= j:
                    yield i * _TILE, j * _TILE, self._product(one, two, min(_TILE, ni - i * _TILE), min(_TILE, nj - j * _TILE))

    def _fold(self) -> None:
        ni, nj = len(self.names[0]), len(self.names[-1])
        sums = {k: np.zeros((ni, nj)) for k in self.SUMS}
        for k, old in (self.sums or {}).items():
            sums[k][:old.shape[0], :old.shape[1]] = old
        for i, j, found in self._tiles():
            for k, x in found.items():
                sums[k][i:i + x.shape[0], j:j + x.shape[1]] += x
        self.sums, self.t = sums, -1

    def _all(self) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
        if self.sums is None:
            yield from self._tiles()
            return
        self._fold()
        ni, nj = self.sums["n"].shape
        for i in range(0, ni, _TILE):
            for j in range(i if self.same else 0, nj, _TILE):
                yield i, j, {k: x[i:i + _TILE, j:j + _TILE] for k, x in self.sums.items()}

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ni = list(self.names[0])
        nj = ni if self.same else list(self.names[1])
        names = np.array([*ni, *nj], dtype=object)
        rank = np.unique(names, return_inverse=True)[1]
        words = pa.array(names, pa.string())
        for lo, left, t in self._all():
            i, j = np.nonzero(t["n"] > 0)
            at_i, at_j = i + lo, j + left + len(ni)
            swap = rank[at_i] > rank[at_j]
            t = {k: x[i, j] for k, x in t.items()}
            if self.same and lo == left:
                keep = ~swap
                at_i, at_j, swap, t = at_i[keep], at_j[keep], swap[keep], {k: x[keep] for k, x in t.items()}
            for x, y in (("sx", "sy"), ("sxx", "syy")):
                t[x], t[y] = np.where(swap, t[y], t[x]), np.where(swap, t[x], t[y])
            first, second = np.where(swap, at_j, at_i), np.where(swap, at_i, at_j)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(first)), words.take(pa.array(second)), *[pa.array(t[k]) for k in self.SUMS]], schema=schema)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block pair and date; a block pair hands on its sums when it ends."""
    schema = pa.schema([("sym_i", pa.string()), ("sym_j", pa.string()), *[(k, pa.float64()) for k in _PairBlock.SUMS]])
    pair, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bi, bj = batch.column("bi").to_numpy(), batch.column("bj").to_numpy()
        cuts = [0, *(np.flatnonzero((bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1), len(bi)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if (bi[lo], bj[lo]) != pair:
                if held:
                    yield from held.rows(schema)
                pair, held = (bi[lo], bj[lo]), _PairBlock(bi[lo] == bj[lo])
            held.add(batch.slice(lo, hi - lo))
    if held:
        yield from held.rows(schema)


def pair_sums(rets: DataFrame, blocks: int | None = None, salt: int = 4) -> DataFrame:
    """n, Σx, Σy, Σx², Σy², Σxy for each pair i<=j over their common dates.

    Dates are vectors cut into blocks of symbols (counted when the plan is built, unless `blocks` is given). Blocks are as
    many as give two pairs of them a task, of 1,024 symbols at least, and more where a block had over `_BLOCK_CELLS` returns,
    down to 1,024 symbols. A vector is sent once per other block: what is sent grows with the tasks, hardly with the symbols.
    A task sums a block pair over its dates, tile by tile, and no pair is shuffled; only where there are few pairs of blocks and
    fewer pairs of symbols than returns to send are they cut into `salt` shares of the dates, whose sums are added.
    Pairs grow as the square of the symbols.
    """
    rets = rets.where("ret is not null and ts is not null and symbol is not null")
    spark = rets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = None
    if blocks is None:
        rets = stored(rets)
        symbols, rows = rets.agg(F.approx_count_distinct("symbol"), F.count(F.lit(1))).first()
        blocks = max(1, min(-(-symbols // _TILE), max(math.isqrt(4 * tasks) + 1, -(-rows // _BLOCK_CELLS))))
        whole = rows * blocks < symbols * symbols
    pairs = blocks * (blocks + 1) // 2
    whole = whole or pairs >= 2 * tasks
    vec = (rets.withColumn("blk", F.pmod(F.hash("symbol"), F.lit(blocks)))
           .groupBy("ts", "blk").agg(F.collect_list(F.struct("symbol", F.col("ret").cast("double").alias("ret"))).alias("v"))
           .select("ts", "blk", F.col("v.symbol").alias("s"), F.col("v.ret").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")))
    both = vec.select(F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "ts", (F.col("blk") > F.col("o")).cast("int").alias("side"), "s", "v")
    share = [] if whole else [F.pmod(F.xxhash64("ts"), F.lit(salt))]
    dealt = both.repartition(min(pairs, 10_000) if whole else tasks, "bi", "bj", *share).sortWithinPartitions("bi", "bj", "ts", "side")
    sums = dealt.mapInArrow(_gram, "sym_i string, sym_j string, n double, sx double, sy double, sxx double, syy double, sxy double")
    return sums if whole else sums.groupBy("sym_i", "sym_j").agg(*[F.sum(c).alias(c) for c in _PairBlock.SUMS])


def covariance(rets: DataFrame, scale: float = 1.0) -> DataFrame:
    """Sample covariance times `scale`, pairs i<=j."""
    s = pair_sums(rets)
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
    return s.where("n > 1").select("sym_i", "sym_j", (cov * scale).alias("cov"))


def correlation(rets: DataFrame) -> DataFrame:
    s = pair_sums(rets)
    n = F.col("n")
    num = n * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt(n * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.where("n > 1").select("sym_i", "sym_j", F.try_divide(num, den).alias("corr"))


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """Add the mirrored half of an i<=j matrix, in one pass."""
    i, j = F.col("sym_i"), F.col("sym_j")
    both = F.array_compact(F.array(F.struct(i.alias("i"), j.alias("j")), F.when(i != j, F.struct(j.alias("i"), i.alias("j")))))
    return pairs.select(F.explode(both).alias("_p"), value).select(F.col("_p.i").alias("sym_i"), F.col("_p.j").alias("sym_j"), value)


def contingency(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    j = df.join(F.broadcast(r))  # one row
    return (j.groupBy(equal_width_bin(F.col(x), F.col("x0"), F.col("x1"), bins).alias("bx"),
                      equal_width_bin(F.col(y), F.col("y0"), F.col("y1"), bins).alias("by"))
            .agg(F.count(F.lit(1)).alias("n")))


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, combine=None) -> DataFrame:
    """Run a user function on each Arrow batch; `combine(DataFrame)` folds the partial rows."""
    def run(frames):
        for f in frames:
            yield fn(f)
    out = df.mapInPandas(run, schema)
    return combine(out) if combine else out


def request_log(df: DataFrame, ok: Column, seconds: str, keys: list[str], users: int = 1, split=None) -> DataFrame:
    n = F.count(F.lit(1))
    base = df.groupBy(*keys).agg(n.alias("requests"), (F.count_if(~ok) / n).alias("error_rate"), F.avg(seconds).alias("mean"),
                                 (n * users / F.sum(seconds)).alias("per_second"))
    return base.join(quantiles(df, keys, seconds, {"median": 0.5, "p95": 0.95, "p99": 0.99}, split=split), keys)


def distributed_quantile(df: DataFrame, col: str, probs: dict[str, float], keys: list[str], exact: bool = True) -> DataFrame:
    """VaR of many assets: exact by default, or the bounded-memory sketch."""
    if exact:
        return quantiles(df, keys, col, probs)
    got = df.groupBy(*keys).agg(F.approx_percentile(col, [float(p) for p in probs.values()], 10000).alias("_q"))
    return got.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
