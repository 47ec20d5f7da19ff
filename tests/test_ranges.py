"""Scans along keys that spread over many ranges and Arrow batches, against a loop."""
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.plans.ordered import running
from tidemark.plans.ranges import apply_map, in_ranges, last_known, scan_before, scan_levels


def rows_of(n, seed=1):
    """Two thirds in one key; null keys, and keys of one row."""
    rng = random.Random(seed)
    keys = ["hot"] * 8 + ["b", None, "c"]
    return [(rng.choice(keys) if i % 50 else f"lone{i}", i, rng.choice([None, float(rng.randint(-9, 9))])) for i in range(n)]


@pytest.fixture(params=[3, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_scans(spark, batches, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    v = F.coalesce("v", F.lit(0.0))
    found = scan_before(in_ranges(df, ["k"], ["i"]), ["k"], {"x": ("affine", F.lit(0.5), v, 3.0), "y": ("reflect", v, F.when(v < 0, 0.0).otherwise(float("-inf")), 0.0), "n": ("affine", F.lit(1.0), F.lit(1.0), 0.0)})
    found = found.withColumn("after", apply_map("affine", F.lit(0.5), v, F.col("x")))
    want, state = {}, {}
    for k, i, value in rows:
        x, y, m = state.get(k, (3.0, 0.0, 0.0))
        v = value or 0.0
        want[i] = (x, y, m, 0.5 * x + v)
        state[k] = (0.5 * x + v, max(y + v, 0.0) if v < 0 else y + v, m + 1)
    got = {r.i: (r.x, r.y, r.n, r.after) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_last_known(spark, batches, n):
    rows = rows_of(n, 2)
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    pair = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    found = running(df, ["k"], ["i"], {"last": ("last", F.col("v")), "pair": ("last", pair)}, split=True)
    plain = running(df, ["k"], ["i"], {"last": ("last", F.col("v")), "pair": ("last", pair)}, split=False)
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str) and found.columns == plain.columns
    assert last_known(df, ["k"], ["i"], {"last": F.col("v")}).count() == n


def test_one_exchange_of_the_rows(spark):
    df = spark.createDataFrame(rows_of(50), "k string, i int, v double")
    plan = in_ranges(df, ["k"], ["i"])
    assert plan.rdd.getNumPartitions() > 1
    text = scan_before(plan, ["k"], {"x": ("affine", F.lit(1.0), F.lit(1.0), 0.0)})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text  # the sort was written; after it rows stay where they are


def test_average_cost_equals_a_ledger(spark):
    rng = random.Random(5)
    rows = [("p" if rng.random() < 0.8 else f"q{i % 7}", "S", i, rng.choice(["buy", "sell"]), float(rng.randint(0, 9)), float(rng.randint(1, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "portfolio string, symbol string, seq long, action string, quantity double, price double").withColumn("ts", F.timestamp_seconds("seq"))
    got = {(r.portfolio, r.ts.timestamp()): (r.held, r.avg_price, r.realized, r.n) for r in B.average_cost(df).collect()}
    state = {}
    for p, s, i, action, q, price in rows:
        held, avg, n = state.get(p, (0.0, 0.0, 0))
        held, avg, gain = B._after(held, avg, action, q, price)
        assert got[(p, float(i))] == pytest.approx((held, avg, gain, n), rel=1e-9, abs=1e-9)
        state[p] = (held, avg, n + 1)
    assert len(got) == len(rows)


@pytest.mark.parametrize("cells,portfolios,dates", [(1 << 22, 2048, 512), (60, 4, 3), (1, 1, 1)])
def test_portfolio_returns_by_blocks(spark, cells, portfolios, dates):
    from tidemark.operators.align import portfolio_returns
    rng = random.Random(7)
    rets = [(f"s{i % 9}", 100 * (i // 12), rng.choice([None, rng.uniform(-1, 1)])) for i in range(150)]  # repeated rows, and dates without some symbols
    weights = [(i % 11 if i % 11 else None, f"s{rng.randrange(12)}", rng.choice([None, 0.0, rng.uniform(-2, 2)])) for i in range(60)]
    want = {}
    for p, s, w in weights:
        for t, ts, r in rets:
            if s == t and w is not None and r is not None:
                want[(p, ts)] = want.get((p, ts), 0.0) + w * r
    a = spark.createDataFrame(rets, "symbol string, t long, ret double").withColumn("ts", F.timestamp_seconds("t"))
    b = spark.createDataFrame(weights, "portfolio int, symbol string, weight double")
    got = {(r.portfolio, int(r.ts.timestamp())): r.ret for r in portfolio_returns(a, b, cells, portfolios, dates).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert portfolio_returns(a.limit(0), b).count() == 0 and portfolio_returns(a, b.limit(0)).count() == 0


def test_returns_go_only_where_their_symbol_is_held(spark):
    """Portfolios that share no symbol: a symbol's returns meet one or two ranges of portfolios, not every block of them."""
    from tidemark.operators import align
    r = spark.range(4000).selectExpr("concat('s', id div 20) symbol", "timestamp_seconds(id % 20) ts", "1.0D ret")
    w = spark.range(2000).selectExpr("id div 2 portfolio", "concat('s', id div 10) symbol", "0.5D weight").repartitionByRange(10, "portfolio").withColumn("_p", F.spark_partition_id())
    right, left = align._met(r, w, 1)
    assert right.count() <= 2 * 200 and right.selectExpr("sum(size(entries)) n").first().n <= 2 * 4000
    assert left.count() == 2000 and left.select("_p").distinct().count() == 10
    got = align.portfolio_returns(r, w.drop("_p"))
    assert got.count() == 1000 * 20 and got.where("ret != 1").count() == 0


def test_a_portfolio_goes_on_in_the_next_piece(spark, monkeypatch):
    """Terms are bounded per piece: a portfolio with more of them is summed over pieces and batches."""
    import pyarrow as pa
    from tidemark.operators import align
    monkeypatch.setattr(align, "_TERMS", 4)
    kind = pa.list_(pa.struct([("ts", pa.int64()), ("ret", pa.float64())]))
    names = ["_p", "_d", "_side", "portfolio", "symbol", "weight", "entries"]
    rows = [(0, 0, 0, None, s, None, [{"ts": t, "ret": float(t + 1)} for t in range(3)]) for s in "abc"] + [(0, 0, 1, p, s, 1.0, None) for p in (None, 1, 2) for s in "abcd"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.float64(), kind]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 2]), kinds)], names=names) for i in range(0, len(rows), 2)]
    got = [tuple(x.values()) for b in align._products(iter(batches)) for x in b.to_pylist()]
    assert sorted(got, key=str) == sorted([(p, t, 3.0 * (t + 1)) for p in (None, 1, 2) for t in range(3)], key=str)


def test_products_leave_little_on_disk(spark, tmp_path):
    """Ranges that hold the same symbols become one, returns travel with dates in a list of their own, and what was
    shuffled on the way to the stored inputs is gone."""
    from tidemark.operators import align
    from tidemark.plans import session
    r = spark.range(30 * 40).selectExpr("concat('s', id div 40) symbol", "cast(date_add(date'2024-01-01', int(id % 40)) as timestamp) ts", "1.0D ret")
    w = spark.range(64 * 30).selectExpr("id div 30 portfolio", "concat('s', id % 30) symbol", "0.5D weight")
    right, left = align._met(r, w.withColumn("_p", (F.col("portfolio") % 4).cast("int")), 3)
    assert right.selectExpr("sum(size(entries)) n", "sum(size(days)) d").first() == (4 * 30 * 40, 4 * 30 * 40) and left.count() == 3 * 64 * 30
    dealt = w.repartitionByRange(32, "portfolio").withColumn("_p", F.spark_partition_id())
    ranges = dealt.select("_p").distinct().count()
    assert align._layout(r, dealt, 32, 1 << 22, 40, 4096, 2) == (16, 1)  # 32 ranges of the same symbols: two blocks are enough
    assert ranges >= 16 and align._layout(r, dealt, 32, 100, 40, 4096, 2) == (32, 12)  # twelve blocks of dates give tasks enough
    got = align.portfolio_returns(r, w)
    assert got.schema["ts"].dataType.simpleString() == "timestamp" and got.count() == 64 * 40 and got.where("ret != 15").count() == 0
    assert got.agg(F.min("ts"), F.max("ts")).first() == r.agg(F.min("ts"), F.max("ts")).first()

    def kept() -> int:
        blocks = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(blocks.apply(i).getName().startswith("shuffle_") for i in range(blocks.size()))

    before = kept()
    rows = session.stored(spark.range(1000).repartition(5, "id").withColumn("k", F.col("id") % 7))
    for _ in range(100):  # files go a moment after the write
        if kept() > before:
            time.sleep(0.1)
    assert kept() <= before
    assert rows.count() == 1000 and rows.columns == ["id", "k"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_filtered_volatility_equals_the_rule(spark):
    from tidemark.streaming.rules import VolatilityFilter
    from tidemark.streaming.ticks import filtered_volatility
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else f"s{i % 5}", i, rng.choice([0.0, rng.gauss(0, 0.02)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "symbol string, i long, ret double").withColumn("ts", F.timestamp_seconds("i"))
    got = {(r.symbol, int(r.ts.timestamp())): r.volatility for r in filtered_volatility(df).collect()}
    rule, state = VolatilityFilter(), {}
    for k, i, ret in rows:
        state[k], (v,) = rule.advance(state.get(k) or rule.init(), ret)
        assert got[(k, i)] == pytest.approx(v, rel=1e-9)
    assert len(got) == len(rows) and filtered_volatility(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_scans_that_build_on_scans(spark, batches, n):
    rows = [(k, i, v or 0.0) for k, i, v in rows_of(n, 3)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    levels = [{"x": ("affine", lambda c: (0.5, c["v"]), 3.0)}, {"y": ("reflect", lambda c: (c["x"] + c["v"], -1.0), 0.0)}, {"z": ("affine", lambda c: (0.25, c["x"] * c["y"]), 1.0)}]
    ranged = in_ranges(df, ["k"], ["i"])
    found = scan_levels(ranged, ["k"], ["v"], levels, after=["z"])
    want, state = {}, {}
    for k, i, v in rows:
        x, y, z = state.get(k, (3.0, 0.0, 1.0))
        state[k] = (0.5 * x + v, max(y + x + v, -1.0), 0.25 * z + x * y)
        want[i] = (x, y, z, state[k][2])
    got = {r.i: (r.x, r.y, r.z, r._after_z) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)
    assert found.columns == [*ranged.columns, "x", "y", "z", "_after_z"]


def test_ledger_rows_are_written_once(spark, monkeypatch):
    from tidemark.plans import ranges
    written, rows = [], [("p", "S", i, "buy", 1.0, 2.0) for i in range(40)]
    monkeypatch.setattr(ranges, "materialized", lambda df, write=ranges.materialized: written.append(df) or write(df))
    df = spark.createDataFrame(rows, "portfolio string, symbol string, seq long, action string, quantity double, price double").withColumn("ts", F.timestamp_seconds("seq"))
    ledger = B.average_cost(df, ["portfolio", "symbol"])
    assert ledger.columns == ["portfolio", "symbol", "held", "avg_price", "realized", "n"] and ledger.count() == 40
    assert len(written) == 1  # three times before: the sort and both scans
    prices = spark.createDataFrame([("S", 3.0)], "symbol string, price double")
    row, = B.positions_summary(ledger, prices).collect()
    assert row[:2] == ("p", "S") and row[2:] == pytest.approx((40.0, 2.0, 3.0, 0.0, 120.0, 40.0))
