"""Scans along keys of any size: one range-partitioned sort, and one small row per partition.

Rows are cut by (key, order) into sorted ranges, whatever the keys, so a hot key lies in many tasks. Each task scans its
range alone, Arrow batch by Arrow batch. What the last key of a range hands on to the next one fits one row per
partition: those rows are chained and sent back as a table of that size. There is one exchange of the rows.

A scan's rows are maps x -> f(x) of a state, which compose associatively:

* `affine`: x -> a x + b, as of averages, decays and filters with constant gain;
* `reflect`: x -> max(x + a, b), as of holdings that a sale cannot bring below zero.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tidemark.plans.session import materialized

#: Composition of an earlier map with a later one, and the map's value.
COMPOSE = {"affine": lambda a, b, c, d: (a * c, c * b + d), "reflect": lambda a, b, c, d: (a + c, np.maximum(b + c, d))}
IDENTITY = {"affine": (1.0, 0.0), "reflect": (0.0, -np.inf)}


def apply_map(kind: str, a: Column, b: Column, x: Column) -> Column:
    return a * x + b if kind == "affine" else F.greatest(x + a, b)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pid", F.spark_partition_id())


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) cut into sorted ranges of (keys, order), written once; `_pid` numbers them. `order`
    must be total."""
    return materialized(_ranged(df, keys, order).select(*(keep or df.columns), "_pid"))  # another run of the sort might draw other borders


def _begins(batch: pa.RecordBatch, keys: Sequence[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether a key begins in each row, given the row before the batch."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for k in keys:
        c = batch.column(k)
        before = pa.concat_arrays([last.column(k) if last is not None else c.slice(0, 1), c.slice(0, n - 1)])
        differ = pc.fill_null(pc.not_equal(c, before), False)
        out |= pc.or_(differ, pc.xor(pc.is_null(c), pc.is_null(before))).to_numpy(zero_copy_only=False)
    out[0] |= last is None
    return out


def _composed(kind: str, a: np.ndarray, b: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of all maps of a run up to each row; `offset` counts rows from the run's first. Spans double."""
    a, b, d, most = a.copy(), b.copy(), 1, int(offset.max(initial=0))
    while d <= most:
        i = np.flatnonzero(offset >= d)
        a[i], b[i] = COMPOSE[kind](a[i - d], b[i - d], a[i], b[i])
        d *= 2
    return a, b


def _offsets(begins: np.ndarray) -> np.ndarray:
    at = np.arange(len(begins))
    return at - np.maximum.accumulate(np.where(begins, at, 0))


def _scan_local(keys: Sequence[str], kinds: dict[str, str], names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, done = None, True, 0
        state = {n: IDENTITY[k] for n, k in kinds.items()}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            begins = _begins(batch, keys, last)
            first = last is None
            runs = np.cumsum(begins)
            in_head = (runs <= 1) if first else (runs == 0) & head
            start = begins.copy()
            start[0] = True
            offset = _offsets(start)
            columns = []
            for n, kind in kinds.items():
                a, b = (batch.column(f"_{c}_{n}").to_numpy(zero_copy_only=False).astype(float) for c in "ab")
                a, b = _composed(kind, a, b, offset)
                if not begins[0]:  # the key goes on from the batch before
                    m = runs == 0
                    a[m], b[m] = COMPOSE[kind](*state[n], a[m], b[m])
                ea, eb = np.append(state[n][0], a[:-1]), np.append(state[n][1], b[:-1])
                ea[begins], eb[begins] = IDENTITY[kind]
                state[n] = (a[-1], b[-1])
                columns += [pa.array(ea), pa.array(eb)]
            head, last = bool(in_head[-1]), batch.slice(size - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(in_head), pa.array(done + np.arange(size)), *columns], names=names)
            done += size

    return run


def scan_before(ranged: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Column, Column, float]]) -> DataFrame:
    """Adds per entry name: (kind, a, b, start) the state before each row; the state after it is `apply_map` of it.

    `ranged` comes from `in_ranges`, possibly by way of columns added to it. It is read once, and what is found in each
    range is written before the ranges are chained.
    """
    kinds = {n: s[0] for n, s in specs.items()}
    own = [f"_{c}_{n}" for n in specs for c in "ab"]
    given = ranged.withColumns({f"_{c}_{n}": s[i].cast("double") for n, s in specs.items() for i, c in ((1, "a"), (2, "b"))})
    more = [f"_e{c}_{n}" for n in specs for c in "ab"]
    schema = StructType([*given.schema.fields, StructField("_head", BooleanType()), StructField("_at", LongType()), *[StructField(c, DoubleType()) for c in more]])
    local = materialized(given.mapInArrow(_scan_local(keys, kinds, schema.names), schema))
    key = F.struct(*keys)
    ends = local.groupBy("_pid").agg(F.min_by(key, "_at").alias("first"), F.max_by(F.struct(key.alias("key"), "_head", *own, *more), "_at").alias("last")).collect()  # one row per partition
    carried, state, before = [], {n: s[3] for n, s in specs.items()}, None
    for row in sorted(ends, key=lambda r: r["_pid"]):
        enter = state if before is not None and row["first"] == before else {n: s[3] for n, s in specs.items()}
        carried.append((row["_pid"], *[float(enter[n]) for n in specs]))
        t, state = row["last"], {}
        for n, s in specs.items():
            a, b = COMPOSE[s[0]](t[f"_ea_{n}"], t[f"_eb_{n}"], t[f"_a_{n}"], t[f"_b_{n}"])
            x = enter[n] if t["_head"] else s[3]
            state[n] = a * x + b if s[0] == "affine" else max(x + a, b)
        before = t["key"]
    table = ranged.sparkSession.createDataFrame(carried, "_pid int, " + ", ".join(f"`_x_{n}` double" for n in specs))
    out = local.join(F.broadcast(table), "_pid")
    for n, s in specs.items():
        x = F.when(F.col("_head"), F.col(f"_x_{n}")).otherwise(F.lit(float(s[3])))
        out = out.withColumn(n, apply_map(s[0], F.col(f"_ea_{n}"), F.col(f"_eb_{n}"), x))
    return out.select(*ranged.columns, *specs)


def _walk(keys: Sequence[str], inputs: Sequence[str], levels: Sequence[dict], enter: dict[int, dict[str, float]], names: Sequence[str], after_of: Sequence[str] | None):
    """The states along a range, which is entered as `enter` tells: a row's states, or (`after_of` None) one row about the
    range's ends."""
    steps = {n: s for level in levels for n, s in level.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        whole, state, total = True, {}, {n: IDENTITY[s[0]] for n, s in steps.items()}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            begins = _begins(batch, keys, last)
            if last is None:  # the first key of the range goes on from what is handed to the range
                first, begins[0] = batch.slice(0, 1), False
                state = dict(enter.get(batch.column("_pid")[0].as_py()) or {n: s[2] for n, s in steps.items()})
            whole &= not begins.any()
            head, start = np.cumsum(begins) == 0, begins.copy()
            start[0] = True
            offset = _offsets(start)
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in inputs}
            added = []
            with np.errstate(divide="ignore", invalid="ignore"):
                for n, (kind, maps, x0) in steps.items():
                    a, b = _composed(kind, *(np.broadcast_to(np.asarray(c, float), size) for c in maps(columns)), offset)
                    x = np.where(head, state[n], x0)
                    after = a * x + b if kind == "affine" else np.maximum(x + a, b)
                    before = np.append(state[n], after[:-1])
                    before[begins] = x0
                    if whole:
                        total[n] = COMPOSE[kind](*total[n], a[-1], b[-1])
                    columns[n], state[n] = before, float(after[-1])
                    added += [before, after] if n in (after_of or ()) else [before]
            last = batch.slice(size - 1, 1)
            if after_of is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=names)
        if last is not None and after_of is None:
            values = [float(v) for n in steps for v in (state[n], *total[n])]
            yield pa.RecordBatch.from_arrays([last.column("_pid"), pa.array([whole]), *[e.column(k) for e in (first, last) for k in keys], *[pa.array([v]) for v in values]], names=names)

    return run


def scan_levels(ranged: DataFrame, keys: Sequence[str], inputs: Sequence[str], levels: Sequence[dict[str, tuple[str, Callable, float]]], after: Sequence[str] = ()) -> DataFrame:
    """Adds per entry name: (kind, maps, start) of the levels the state before each row, and for the names in `after` that
    after it, as `_after_<name>`.

    `maps` takes a dict of arrays, the columns `inputs` and the states before each row of the levels above, and returns a and
    b of the rows' maps. `ranged` comes from `in_ranges` and is not written again: a first pass over keys and inputs gives the
    ends of each range, the result walks it with the states handed on. Only ranges that go on with one key from begin to end
    (a key of several ranges) are read once more for each level below the first.
    """
    steps = {n: s for level in levels for n, s in level.items()}
    kinds, width = {f.name: f for f in ranged.schema.fields}, len(keys)
    ends_schema = StructType([kinds["_pid"], StructField("whole", BooleanType()), *[StructField(f"{e}_{k}", kinds[k].dataType) for e in ("first", "last") for k in keys],
                              *[StructField(f"{e}_{n}", DoubleType()) for n in steps for e in ("end", "a", "b")]])
    lean = ranged.select(*keys, "_pid", *inputs)

    def ends_of(df: DataFrame, enter: dict) -> dict[int, tuple]:
        rows = df.mapInArrow(_walk(keys, inputs, levels, enter, ends_schema.names, None), ends_schema).collect()  # one row per partition
        return {r[0]: (r[1], tuple(r[2:2 + width]), tuple(r[2 + width:2 + 2 * width]), {n: tuple(r[f"{e}_{n}"] for e in ("end", "a", "b")) for n in steps}) for r in rows}

    def chained(ends: dict[int, tuple]) -> tuple[dict[int, dict[str, float]], list[int]]:
        enter, through, before, state = {}, [], None, {}
        for pid in sorted(ends):
            whole, first, last, found = ends[pid]
            goes_on = before is not None and first == before
            enter[pid] = x = state if goes_on else {n: s[2] for n, s in steps.items()}
            if whole and goes_on:
                through.append(pid)
                state = {n: a * x[n] + b if steps[n][0] == "affine" else max(x[n] + a, b) for n, (_, a, b) in found.items()}
            else:
                state = {n: end for n, (end, _, _) in found.items()}
            before = last
        return enter, through

    ends = ends_of(lean, {})
    enter, through = chained(ends)
    for _ in levels[1:] if through else ():  # a level's maps are right once the states above it are
        ends.update(ends_of(lean.where(F.col("_pid").isin(through)), enter))
        enter, _ = chained(ends)
    schema = StructType([*ranged.schema.fields, *[StructField(c, DoubleType()) for n in steps for c in ([n, f"_after_{n}"] if n in after else [n])]])
    return ranged.mapInArrow(_walk(keys, inputs, levels, enter, schema.names, tuple(after)), schema)


def _fill_local(keys: Sequence[str], values: Sequence[str], names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, done = None, True, 0
        held: list[pa.Array] = []
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            begins = _begins(batch, keys, last)
            runs, at = np.cumsum(begins), np.arange(size)
            in_head = (runs <= 1) if last is None else (runs == 0) & head
            start = np.maximum.accumulate(np.where(begins, at, -1))
            filled = []
            for i, c in enumerate(values):
                column = batch.column(c)
                seen = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), at, -1))
                seen = np.where(seen >= start, seen, -1)
                if held and not begins[0]:  # row 0 of the joined array is the value of the batch before
                    column, seen = pa.concat_arrays([held[i], column]), np.where((seen < 0) & (runs == 0), 0, np.where(seen < 0, -1, seen + 1))
                filled.append(column.take(pa.array(seen, mask=seen < 0)))
            held = [c.slice(size - 1, 1) for c in filled]
            head, last = bool(in_head[-1]), batch.slice(size - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(in_head), pa.array(done + at), *filled], names=names)
            done += size

    return run


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds per entry the latest non-null value of its key so far, its own row included. `order` must be total."""
    ins, outs = {f"_in_{n}": c for n, c in values.items()}, [f"_l_{n}" for n in values]
    ranged = _ranged(materialized(df.withColumns(ins)), keys, order)  # the sort samples its input: written once, it is not computed twice
    schema = StructType([*ranged.schema.fields, StructField("_head", BooleanType()), StructField("_at", LongType()), *[StructField(o, ranged.schema[i].dataType) for o, i in zip(outs, ins)]])
    local = materialized(ranged.mapInArrow(_fill_local(keys, list(ins), schema.names), schema))
    key = F.struct(*keys)
    ends = local.groupBy("_pid").agg(F.min_by(key, "_at").alias("first"), F.max_by(F.struct(key.alias("key"), *outs), "_at").alias("last"))
    nothing = [F.lit(None).cast(ranged.schema[i].dataType).alias(o) for o, i in zip(outs, ins)]
    both = ends.select("_pid", F.lit(0).alias("side"), F.col("first").alias("key"), *nothing).unionByName(ends.select("_pid", F.lit(1).alias("side"), "last.key", *[F.col(f"last.{o}").alias(o) for o in outs]))
    earlier = Window.partitionBy("key").orderBy("_pid", "side").rowsBetween(Window.unboundedPreceding, -1)  # two rows per partition
    carry = both.withColumns({f"_c_{n}": F.last(f"_l_{n}", ignorenulls=True).over(earlier) for n in values}).where("side = 0").select("_pid", *[f"_c_{n}" for n in values])
    out = local.join(F.broadcast(carry), "_pid")
    return out.withColumns({n: F.coalesce(f"_l_{n}", F.when(F.col("_head"), F.col(f"_c_{n}"))) for n in values}).select(*df.columns, *values)
