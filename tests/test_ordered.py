"""The split form of every ordered helper equals the plain form, with one key holding most rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, indicators as I
from tidemark.plans import ordered
from tidemark.plans.ordered import over_rows, quantiles, row_index, running, stepwise


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 1200
    sym = np.where(rng.random(n) < 0.8, "HOT", rng.choice(["B", "C"], n))
    x = np.round(rng.normal(0, 1, n), 2)
    pdf = pd.DataFrame({"symbol": sym, "ts": np.arange(n), "x": x, "close": 100 + x, "y": np.where(rng.random(n) < 0.3, np.nan, x)})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(7)
    return df.persist(), pdf


def rows(df, *cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def same(a, b):
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12, atol=1e-12)


def test_row_index(frame):
    df, _ = frame
    same(rows(row_index(df, ["symbol"], ["ts"], split=False), "_rn"), rows(row_index(df, ["symbol"], ["ts"], split=True), "_rn"))


@pytest.mark.parametrize("block", [7, 64])
def test_sliding_and_lead(frame, block):
    df, _ = frame
    def build(w):
        return {"m": F.avg("x").over(w.rowsBetween(-4, 0)), "nxt": F.lead("x", 2).over(w), "prev": F.lag("x").over(w)}
    kw = dict(ahead=2)
    a = over_rows(df, ["symbol"], ["ts"], 4, build, split=False, **kw)
    b = over_rows(df, ["symbol"], ["ts"], 4, build, split=True, block=block, **kw)
    same(rows(a, "m", "nxt", "prev"), rows(b, "m", "nxt", "prev"))


def test_running(frame):
    df, _ = frame
    spec = {"s": ("sum", F.col("y")), "hi": ("max", F.col("y")), "lo": ("min", F.col("x")), "l": ("last", F.col("y")), "c": ("count", F.col("y")),
            "p": ("product", 1 + F.col("x") / 1000)}
    a, b = running(df, ["symbol"], ["ts"], spec, split=False), running(df, ["symbol"], ["ts"], spec, split=True, block=50)
    same(rows(a, *spec), rows(b, *spec))


def test_quantiles(frame):
    df, pdf = frame
    probs = {"a": 0.013, "m": 0.5, "z": 0.97}
    got = quantiles(df, ["symbol"], "x", probs, split=True).toPandas().set_index("symbol")
    for s, g in pdf.groupby("symbol"):
        np.testing.assert_allclose(got.loc[s, ["a", "m", "z"]].astype(float), np.percentile(g.x, [1.3, 50, 97]), rtol=1e-12)


@pytest.mark.parametrize("split", [False, True])
def test_ema_matches_pandas(frame, split):
    df, pdf = frame
    got = rows(I.ema(df, 5, "close", split=split), "ema")
    want = pdf.sort_values(["symbol", "ts"]).groupby("symbol").close.transform(lambda s: s.ewm(span=5, adjust=True).mean())
    np.testing.assert_allclose(got.ema, want, rtol=1e-12)


def test_asof_and_runs_split(frame):
    df, _ = frame
    left, right = df.where("ts % 3 = 0").select("symbol", "ts", "x"), df.where("ts % 3 = 1").select("symbol", "ts", F.col("x").alias("v"))
    a, b = (align.asof(left, right, ["symbol"], F.col("v"), ["ts"], split=s) for s in (False, True))
    same(rows(a, "asof"), rows(b, "asof"))
    a, b = (I.runs(df, ["symbol"], F.col("x") < 0, split=s) for s in (False, True))
    same(rows(a, "run"), rows(b, "run"))


def test_partition_count_does_not_matter(frame):
    df, _ = frame
    got = [rows(I.drawdown(df.repartition(k)), "drawdown") for k in (1, 4, 8)]
    same(got[0], got[1])
    same(got[0], got[2])


def test_unknown_input_takes_the_split_form(spark, frame):
    df, _ = frame
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    same(rows(I.sma(df, 10, "x", split=None), "sma"), rows(I.sma(df, 10, "x", split=False), "sma"))
    plain = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    I.sma(df, 10, "x", split=False)
    assert len(before) <= plain == len(spark.sparkContext.statusTracker().getJobIdsForGroup())  # building a plan runs no job


def test_stepwise_carries_state_over_batches(spark, frame):
    df, pdf = frame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        out = rows(stepwise(df, ["symbol"], ["ts"], lambda: 0.0, lambda s, x: (0.5 * s + x, (0.5 * s + x,)), ["x"], ["symbol", "ts"], "v double"), "v")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for _, g in pdf.sort_values(["symbol", "ts"]).groupby("symbol"):
        s = 0.0
        for x in g.x:
            s = 0.5 * s + x
            want.append(s)
    np.testing.assert_allclose(out.v, want)


def test_quantiles_order_only_the_bins_of_wanted_positions(spark, monkeypatch):
    rng, sorted_rows, one = np.random.default_rng(3), [], ordered.row_index
    monkeypatch.setattr(ordered, "row_index", lambda df, *a, **k: sorted_rows.append(df.count()) or one(df, *a, **k))
    hot = np.concatenate([rng.normal(0, 1, 20_000), [0.0, -0.0, 1e-320, -1e300, np.inf, -np.inf]])
    rows = [("a", float(v)) for v in hot] + [("b", 7.0)] * 50 + [("c", float(v)) for v in (-3, -2, -1)] + [(None, 1.0), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.001, "p1": 0.01, "mid": 0.5, "hi": 0.999}
    got = {r.k: tuple(r)[1:] for r in ordered.quantiles(df, ["k"], "v", probs).collect()}
    want = {r.k: tuple(r)[1:] for r in ordered.quantiles(df, ["k"], "v", probs, split=False).collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()} and len(got) == 4
    assert sorted_rows and max(sorted_rows) < 2_000  # of 20,060 rows
