"""Late and out-of-order streams against the finite table; expiry of silent keys row by row."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ordered as O, rules as R, ticks as T

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "symbol string, ts timestamp, event_id long, price double"


def stream(spark, path, batches):
    """Each batch of rows one file, in order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture
def late(spark, tmp_path):
    rnd = random.Random(5)
    rows = [("AB"[i % 2], T0 + dt.timedelta(seconds=7 * (i // 3)), i, 50.0 + rnd.random()) for i in range(400)]  # ties in time
    arrive = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rnd.randrange(100)))
    cut = [arrive[k:k + 80] for k in range(0, 400, 80)]
    assert any(a[1] > b[1] for a, b in zip(arrive, arrive[1:]))
    return rows, stream(spark, tmp_path / "in", cut)


def test_stream_with_late_rows_equals_the_table(spark, late):
    rows, s = late
    got = T.drain(O.ordered_rule(s, ["symbol"], "ts", ["event_id"], R.PreviousPrice(), ["symbol", "ts", "event_id", "price"], "3 minutes"))
    mark = max(r[1] for r in rows) - dt.timedelta(minutes=3)
    want = {}
    for sym in "AB":
        mine = sorted((r for r in rows if r[0] == sym and r[1] <= mark), key=lambda r: (r[1], r[2]))
        want.update({r[2]: (sym, r[1], r[3], p[3] if p else None) for r, p in zip(mine, [None, *mine])})
    found = got.collect()
    assert len(found) == len(want) > 300
    assert {r.event_id: (r.symbol, r.ts, r.price, r.prev) for r in found} == want


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    s = stream(spark, tmp_path / "in", [[("A", minute(0), 1, 1.0), ("A", minute(30), 2, 2.0)], [("A", minute(40), 3, 3.0)],
                                        [("A", minute(1), 4, 4.0), (None, minute(35), 5, 5.0), ("A", None, 6, 6.0)], [("A", minute(60), 7, 7.0)]])
    got = T.drain(O.ordered_rule(s, ["symbol"], "ts", ["event_id"], R.PreviousPrice(), ["symbol", "event_id"], "10 minutes"))
    assert sorted(map(tuple, got.collect()), key=str) == [("A", 1, None), ("A", 2, 1.0), ("A", 3, 2.0), (None, 5, None)]


def test_silent_keys_expire_and_start_anew(spark, tmp_path):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    batches = [[("A", m(0), 1, 1.0), ("B", m(1), 2, 2.0)], [("A", m(60), 4, 5.0), ("A", m(59), 3, 4.0)], [("B", m(130), 5, 9.0)], [("A", m(200), 6, 7.0)], [("C", m(300), 7, 1.0)]]
    got = T.drain(O.silent_keys(stream(spark, tmp_path / "in", batches), ["symbol"], "ts", ["event_id"], R.Activity(), "1 hour", "5 minutes"))
    assert sorted(map(tuple, got.collect())) == [("A", m(0), m(60), 3, 1.0, 5.0), ("A", m(200), m(200), 1, 7.0, 7.0), ("B", m(1), m(1), 1, 2.0, 2.0), ("B", m(130), m(130), 1, 9.0, 9.0)]


def test_idle_restarts_the_rule(spark, tmp_path):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    s = stream(spark, tmp_path / "in", [[("A", m(0), 1, 1.0)], [("A", m(10), 2, 2.0)], [("A", m(100), 3, 3.0)], [("A", m(110), 4, 4.0)], [("B", m(200), 5, 1.0)]])
    got = T.drain(O.ordered_rule(s, ["symbol"], "ts", ["event_id"], R.PreviousPrice(), ["event_id"], "1 minute", "1 hour"))
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, 1.0), (3, None), (4, 3.0)]


def test_no_rows(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [[]])
    assert T.drain(O.silent_keys(s, ["symbol"], "ts", ["event_id"], R.Activity(), "1 hour")).count() == 0


def test_a_hot_key_waits_in_pieces(monkeypatch):
    """Rows of a hot key are stored as sorted runs in pieces and merged piece by piece, whatever the order of arrival."""
    import pandas as pd
    monkeypatch.setattr(O, "_FEW", 10)
    monkeypatch.setattr(O, "_PIECE", 50)
    monkeypatch.setattr(O, "_RUN", 200)

    class State(dict):
        def get(self):
            return dict.get(self, ())
        def update(self, value):
            self[()] = value
        def getValue(self, key):
            return dict.get(self, key)
        def updateValue(self, key, value):
            assert len(value[0]) < 5_000
            self[key] = value
        def removeKey(self, key):
            del self[key]

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, set()
        def getValueState(self, name, schema):
            return self.states.setdefault(name, State())
        getMapState = lambda self, name, *schema: self.getValueState(name, schema)
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.discard(at)

    class At:
        def __init__(self, ms):
            self.ms = ms
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.ms

    handle, rnd = Handle(), random.Random(3)
    rule = R.PreviousPrice()
    p = O._Ordered(["at_us", "id", "price", "word"], ["bigint", "bigint", "double", "string"], ["at_us", "id"], rule, ["id", "word"], ["id", "word", "prev"], None, False)
    p.init(handle)
    rows = [(1000 * (i // 3), i if i % 11 else None, float(i), None if i % 7 == 0 else f"w{i % 5}") for i in range(3000)]
    rnd.shuffle(rows)
    got, largest = [], 0

    def release(ms):
        nonlocal largest
        while due := [t for t in sorted(handle.timers) if t <= ms]:
            handle.timers.discard(due[0])
            info = At(ms)
            info.getExpiryTimeInMs = lambda: due[0]
            for f in p.handleExpiredTimer(("k",), At(ms), info):
                largest = max(largest, len(f))
                got.extend(f.itertuples(index=False, name=None))

    for lo, mark in ((0, 0), (1000, 300), (2000, 2000)):
        part = rows[lo:lo + 1000]
        part = part if lo == 0 else [r for r in part if r[0] > seen * 1000]
        list(p.handleInputRows(("k",), iter([pd.DataFrame(part[k:k + 70], columns=["at_us", "id", "price", "word"]) for k in range(0, len(part), 70)]), None))
        assert lo or len(handle.states["pieces"]) >= 20
        release(mark)
        seen = mark
    taken = rows[:1000] + [r for r in rows[1000:2000] if r[0] > 0] + [r for r in rows[2000:] if r[0] > 300_000]
    want = sorted(taken, key=lambda r: (r[0], r[1] is not None, r[1]))
    assert [(r[0], r[1]) for r in got] == [(r[1], r[3]) for r in want] and [r[2] for r in got] == [None, *[r[2] for r in want[:-1]]]
    assert largest <= 50 and not handle.states["pieces"] and not handle.timers
