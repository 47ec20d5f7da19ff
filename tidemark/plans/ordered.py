"""Ordered work on keys of any size.

`Window.partitionBy(symbol)` puts a whole symbol into one task. That is right for
bar tables, whose rows per symbol are bounded by the calendar, and wrong for raw
ticks, where one symbol may hold a third of the table. Each helper here has two
physical forms with equal results:

* plain (`split=False`) - one window per key, for input that is declared bounded per key, as bars are;
* split (`split=True`, and `None`: input of unknown shape) - rows get an exact position inside their key from a
  range-partitioned sort, positions are cut into blocks, and windows run per `(key, block)` with
  either copied edge rows (sliding frames) or carried block totals (running frames).

The caller declares the form; nothing is counted while a plan is built.
"""
from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.ranges import last_known
from tidemark.plans.session import materialized

#: Positions per block in the split form.
BLOCK_ROWS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rn",
              split: bool | None = None) -> DataFrame:
    """Zero-based position of each row inside its key. `order` must be a total order."""
    if split is False:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long") - 1)
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = materialized(
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (ranged.groupBy(*keys, "_pid")
              .agg(F.count(F.lit(1)).alias("_held"), F.min("_mid").alias("_first"))
              .withColumn("_skip", F.coalesce(F.sum("_held").over(before), F.lit(0))))
    return (_join_on(ranged, pieces, [*keys, "_pid"])
            .withColumn(name, F.col("_mid") - F.col("_first") + F.col("_skip"))
            .drop("_mid", "_pid", "_held", "_first", "_skip"))


def over_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int,
              build: Callable[[Window], dict[str, Column]], ahead: int = 0,
              split: bool | None = None, block: int | None = None) -> DataFrame:
    """Add window columns that look at most `back` rows behind and `ahead` rows in front."""
    if split is False:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*order)))
    size = max(block or BLOCK_ROWS, back + ahead + 1)
    at, own = F.col("_rn") % size, F.floor(F.col("_rn") / size)
    homes = F.array_compact(F.array(
        own,
        F.when(at >= size - back, own + 1) if back else F.lit(None).cast("long"),
        F.when((at < ahead) & (own > 0), own - 1) if ahead else F.lit(None).cast("long")))
    copies = row_index(df, keys, order, split=True).withColumn("_blk", F.explode(homes))
    cols = build(Window.partitionBy(*keys, "_blk").orderBy("_rn"))
    return copies.withColumns(cols).where(F.col("_blk") == own).drop("_blk", "_rn")


_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product, "count": F.count}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, Column]],
            split: bool | None = None, block: int | None = None) -> DataFrame:
    """Running sum/max/min/product/count/last (last = latest non-null) from the key's first row."""
    if split is False:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({
            n: F.last(c, ignorenulls=True).over(w) if kind == "last" else _AGG[kind](c).over(w)
            for n, (kind, c) in specs.items()})
    if all(kind == "last" for kind, _ in specs.values()):  # carried from range to range: one exchange
        return last_known(df, keys, order, {n: c for n, (_, c) in specs.items()})
    size = block or BLOCK_ROWS
    rows = row_index(df, keys, order, split=True).withColumn("_blk", F.floor(F.col("_rn") / size))
    rows = rows.withColumns({f"_in_{n}": c for n, (_, c) in specs.items()})
    inside = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    total, carry, local = [], {}, {}
    for n, (kind, _) in specs.items():
        src = F.col(f"_in_{n}")
        if kind == "last":
            total.append(F.max_by(src, F.when(src.isNotNull(), F.col("_rn"))).alias(f"_t_{n}"))
            carry[f"_c_{n}"] = F.last(f"_t_{n}", ignorenulls=True).over(earlier)
            local[f"_l_{n}"] = F.last(src, ignorenulls=True).over(inside)
        else:
            total.append(_AGG[kind](src).alias(f"_t_{n}"))
            fold = F.sum if kind == "count" else _AGG[kind]
            carry[f"_c_{n}"] = fold(F.col(f"_t_{n}")).over(earlier)
            local[f"_l_{n}"] = _AGG[kind](src).over(inside)
    blocks = rows.groupBy(*keys, "_blk").agg(*total).withColumns(carry).drop(*[f"_t_{n}" for n in specs])
    out = _join_on(rows.withColumns(local), blocks, [*keys, "_blk"])
    merged = {}
    for n, (kind, _) in specs.items():
        a, b = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind in ("sum", "count"):
            merged[n] = F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
        elif kind == "product":
            merged[n] = F.when(a.isNull(), b).otherwise(a * F.coalesce(b, F.lit(1.0)))
        elif kind == "last":
            merged[n] = F.coalesce(a, b)
        else:
            merged[n] = (F.greatest if kind == "max" else F.least)(a, b)
    scratch = [f"_{p}_{n}" for n in specs for p in ("in", "l", "c")]
    return out.withColumns(merged).drop("_rn", "_blk", *scratch)


#: Bins of wanted positions that are small enough to send to every task.
_FEW_BINS = 10_000


def _value_bin(v: Column) -> Column:
    """A bin of a double that rises with it (NaN last): 128 bins per factor e, on either side of zero."""
    size = F.when(F.abs(v) == float("inf"), F.lit(300_000)).otherwise(F.floor(F.log(F.abs(v)) * 128) + 100_000)
    return F.when(F.isnan(v), F.lit(400_000)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              split: bool | None = None) -> DataFrame:
    """Exact interpolated quantiles per key, one column per entry of `probs`.

    `percentile` keeps every distinct value of a group in one buffer. For a hot
    group the values are counted in ordered bins; those of the few bins that hold a wanted
    position are ordered across tasks and read there.
    """
    df = df.where(F.col(value).isNotNull())
    if split is False:
        names = list(probs)
        got = df.groupBy(*keys).agg(F.percentile(value, [float(probs[n]) for n in names]).alias("_q"))
        return got.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    binned = df.select(*keys, value, _value_bin(F.col(value).cast("double")).alias("_bin"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # at most some 200,000 bins a key
    bins = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_past": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    ranks = [f((F.col("_all") - 1) * F.lit(float(p))) for p in probs.values() for f in (F.floor, F.ceil)]
    held = functools.reduce(lambda a, b: a | b, [(F.col("_past") - F.col("_n") <= r) & (r < F.col("_past")) for r in ranks])
    held = materialized(bins.where(held).select(*keys, "_bin", (F.col("_past") - F.col("_n")).alias("_below"), "_all"))
    few = held.limit(_FEW_BINS + 1).count() <= _FEW_BINS
    kept = _join_on(binned, F.broadcast(held) if few else held, [*keys, "_bin"])
    freq = kept.groupBy(*keys, "_bin", "_below", "_all", value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(freq, [*keys, "_bin"], [value], {"_in": ("sum", F.col("_n"))}, split=True).withColumn("_upto", F.col("_below") + F.col("_in"))
    aggs, out = [], []
    for n, p in probs.items():
        pos = (F.col("_all") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("_upto") > F.floor(pos), F.col(value))).alias(f"_lo_{n}"),
                 F.min(F.when(F.col("_upto") > F.ceil(pos), F.col(value))).alias(f"_hi_{n}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{n}")]
        out.append((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *out)


def full_frame(w: Window, n: int, x: Column, value: Column) -> Column:
    """`value` where the last `n` rows all hold a non-null `x`, else null."""
    return F.when(F.count(x).over(w.rowsBetween(-(n - 1), 0)) == n, value)


def stepwise(df: DataFrame, keys: Sequence[str], order: Sequence[str], init: Callable[[], object],
             advance: Callable, inputs: Sequence[str], keep: Sequence[str], outputs: str) -> DataFrame:
    """Run a sequential rule per key in bounded memory.

    Rows are hash-partitioned by key and sorted. `advance(state, *input values)` is called row by
    row and returns `(state, output values)`; `init()` starts a key. Only the current key's state
    lives in the task, so a key of any size streams through one Arrow batch at a time. The result
    has the `keep` columns and the `outputs` (DDL).
    """
    keys, inputs, keep = list(keys), list(inputs), list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [part.split()[0] for part in outputs.split(", ")]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [outputs])

    def run(frames):
        current, state = None, None
        for frame in frames:
            rows = []
            for row in zip(zip(*[frame[k].tolist() for k in keys]), *[frame[c].tolist() for c in inputs]):
                if row[0] != current:
                    current, state = row[0], init()
                state, out = advance(state, *row[1:])
                rows.append(out)
            if rows:
                result = frame[keep].copy()
                for i, n in enumerate(names):
                    result[n] = [r[i] for r in rows]
                yield result

    need = list(dict.fromkeys([*keys, *inputs, *keep]))
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*need)
    return ordered.mapInPandas(run, schema)
