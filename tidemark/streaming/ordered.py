"""Rules over late and out-of-order streams: rows wait in state until the watermark has passed them.

Event-time timers release a key's rows in order, so a result depends on the rows and not on their micro-batches: it equals
the rule over the finite table of all rows up to the watermark. Rows behind the watermark are dropped, as Structured
Streaming defines it, and a row leaves the buffer no later than that; the buffer of a key holds the rows of one `delay`.

With `idle`, a key that stays silent for that long in event time ends: its state is cleared and the next row starts anew.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import TimestampType

from tidemark.streaming.ticks import ROCKS

_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Rows that a key keeps beside its rule's state, of one stored piece, and of one run sorted before it is cut into pieces.
_FEW, _PIECE, _RUN = 1_000, 20_000, 200_000


def _plain(values: list, kind: str) -> list:
    """Python values of a state column: pandas turns null into NaN and nullable integers into floats."""
    if kind in _WHOLE:
        return [None if v is None or v != v else int(v) for v in values]
    return [None if v is None or v != v else v for v in values]


class _Columns:
    """Rows as arrays, one per column; strings as codes of their different values, -1 for null."""

    def __init__(self, arrays: list, words: dict[int, list]):
        self.arrays, self.words = arrays, words

    def __len__(self):
        return len(self.arrays[0])

    @classmethod
    def of(cls, f: pd.DataFrame, names: Sequence[str]) -> _Columns:
        arrays, words = [], {}
        for i, c in enumerate(names):
            x = f[c]
            if isinstance(x.dtype, np.dtype) and x.dtype != object:
                arrays.append(x.to_numpy().copy())  # not a view that keeps the batch
                continue
            try:
                code, found = pd.factorize(x)
                words[i] = list(found)
                arrays.append(code.astype(np.int32))
            except TypeError:  # lists and structs have no hash
                arrays.append(x.to_numpy(dtype=object))
        return cls(arrays, words)

    def take(self, at) -> _Columns:
        return _Columns([x[at] for x in self.arrays], self.words)

    @staticmethod
    def join(parts: list[_Columns]) -> _Columns:
        if len(parts) == 1:
            return parts[0]
        arrays, words = [], {}
        for i in range(len(parts[0].arrays)):
            xs = [p.arrays[i] for p in parts]
            if all(i in p.words for p in parts):
                place: dict = {}
                xs = [np.array([*[place.setdefault(w, len(place)) for w in p.words[i]], -1], np.int32)[x] for p, x in zip(parts, xs)]
                words[i] = list(place)
            elif any(i in p.words for p in parts):
                xs = [p.column(i) for p in parts]
            arrays.append(np.concatenate(xs))
        return _Columns(arrays, words)

    def column(self, i: int) -> np.ndarray:
        if i not in self.words:
            return self.arrays[i]
        words = np.empty(len(self.words[i]) + 1, dtype=object)
        words[:-1] = self.words[i]
        return words[self.arrays[i]]

    def values(self, i: int, kind: str) -> list:
        x = self.column(i)
        return x.tolist() if x.dtype.kind in "iub" else _plain(x.tolist(), kind)

    def sorted(self, order: Sequence[int]) -> _Columns:
        """By the columns `order`, nulls first."""
        by: list[np.ndarray] = []
        for i in order:
            x = self.arrays[i]
            if i in self.words:
                place = {w: k for k, w in enumerate(sorted(self.words[i]))}
                by.append(np.array([*[place[w] for w in self.words[i]], -1])[x])
            elif x.dtype == object:
                place = {v: k for k, v in enumerate(sorted({v for v in x.tolist() if v is not None}))}
                by.append(np.array([-1 if v is None else place[v] for v in x.tolist()]))
            else:
                by += [x == x, x]
        return self.take(np.lexsort(by[::-1]))


class _Ordered(StatefulProcessor):
    """One key's rule state and waiting rows; `closing` asks for one row per ended key instead of one per input row.

    A few rows wait in the key's head, beside the rule's state: one read and one write per call. More of them wait as
    sorted runs, cut into pieces that are stored one by one; a release merges the runs piece by piece, so memory holds
    pieces that overlap in time and not the key's rows of a micro-batch.
    """

    def __init__(self, columns, kinds, order, rule, keep, names, idle, closing):
        self.columns, self.kinds, self.order, self.rule = columns, kinds, [columns.index(c) for c in order], rule
        self.keep, self.names, self.idle, self.closing = [columns.index(c) for c in keep], names, idle, closing
        self.inputs = [columns.index(c) for c in rule.inputs]

    def init(self, handle):
        self.handle = handle
        self.head = handle.getValueState("head", "blob binary")
        self.pieces = handle.getMapState("pieces", "id bigint", "blob binary")

    def _load(self) -> dict:
        """few: rows that wait here; pieces: (first, id, rows) of those stored; first: the earliest row that waits; timer: the
        timer that is set; state: when opened, last row, the rule's state."""
        got = self.head.get()
        head = pickle.loads(got[0]) if got else {"few": None, "pieces": [], "first": None, "timer": None, "state": None, "id": 0}
        return head | {"few": head["few"] and _Columns(*head["few"])}

    def _save(self, head: dict) -> None:
        few = head["few"]
        self.head.update((pickle.dumps(head | {"few": few and (few.arrays, few.words)}, 5),))  # plain arrays: a class would be shipped with each key

    def _wait(self, head: dict, rows: _Columns) -> None:
        """Rows that join those of the key: in its head while they are few, else as a sorted run in pieces."""
        if len(rows) <= _FEW and not head["pieces"]:
            head["few"] = rows
            return
        head["few"] = None
        rows = rows.sorted(self.order)
        for lo in range(0, len(rows), _PIECE):
            part = rows.take(slice(lo, lo + _PIECE))
            self.pieces.updateValue((head["id"],), (pickle.dumps((part.arrays, part.words), 5),))
            head["pieces"].append((int(part.arrays[0][0]), head["id"]))
            head["id"] += 1

    def _store(self, head: dict) -> None:
        """Writes the head and sets the one timer: for the earliest row that waits, or for the end of a silent key."""
        few, state = head["few"], head["state"]
        firsts = [p[0] for p in head["pieces"]] + ([int(few.arrays[0].min())] if few is not None else [])
        head["first"] = min(firsts) if firsts else None
        due = [-(-head["first"] // 1000)] if firsts else []
        if state and self.idle:
            due.append((state[1] + self.idle) // 1000 + 1)
        if not due:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            if state:
                head["timer"] = None
                self._save(head)
            else:
                self.head.clear()
            return
        if head["timer"] is None or min(due) < head["timer"]:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            head["timer"] = min(due)
            self.handle.registerTimer(head["timer"])
        self._save(head)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head = self._load()
        parts = [] if head["few"] is None else [head["few"]]
        held = sum(map(len, parts))
        for f in rows:
            if len(f):
                parts.append(_Columns.of(f, self.columns))
                held += len(f)
                if held >= _RUN:
                    self._wait(head, _Columns.join(parts))
                    parts, held = [], 0
        if parts:
            self._wait(head, _Columns.join(parts))
        self._store(head)
        return iter(())

    def _close(self, key, state) -> tuple:
        return (*key, state[0], state[1], *self.rule.closing(state[2]))

    def _released(self, head: dict, mark: int) -> Iterator[_Columns]:
        """The rows up to `mark` in order; those left over wait again."""
        due = sorted(p for p in head["pieces"] if p[0] <= mark)
        head["pieces"] = [p for p in head["pieces"] if p[0] > mark]
        pool, left = ([] if head["few"] is None else [head["few"]]), 0
        head["few"] = None
        for k in range(len(due) + 1):
            if k < len(due):
                pool.append(_Columns(*pickle.loads(self.pieces.getValue((due[k][1],))[0])))
                self.pieces.removeKey((due[k][1],))
            if pool and (k >= len(due) - 1 or sum(map(len, pool)) > max(3 * _PIECE, 2 * left)):
                rows = _Columns.join(pool).sorted(self.order)
                end = due[k + 1][0] if k + 1 < len(due) else mark + 1
                cut = int(np.searchsorted(rows.arrays[0], end))
                for lo in range(0, cut, _PIECE):
                    yield rows.take(slice(lo, min(cut, lo + _PIECE)))
                left = len(rows) - cut
                pool = [rows.take(slice(cut, None))] if left else []
        if pool:
            self._wait(head, pool[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        head = self._load()
        if head["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            head["timer"] = None
        state, ended, init, advance, idle = head["state"], [], self.rule.init, self.rule.advance, self.idle
        if head["first"] is not None and head["first"] <= mark:
            for rows in self._released(head, mark):
                times, out = rows.arrays[0].tolist(), []
                opened, last, inner = state or (None, None, None)
                for us, *row in zip(times, *[rows.values(i, self.kinds[i]) for i in self.inputs]):
                    if opened is not None and idle and us - last > idle:
                        if self.closing:
                            ended.append(self._close(key, (opened, last, inner)))
                        opened = None
                    if opened is None:
                        opened, inner = us, init()
                    inner, got = advance(inner, *row)
                    last = us
                    out.append(got)
                state = (opened, last, inner)
                if not self.closing:
                    keep = [rows.values(i, self.kinds[i]) for i in self.keep]
                    yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, [*keep, *map(list, zip(*out))])})
        if state and idle and state[1] + idle < mark:  # a row at that distance would still belong to it
            waits = min([p[0] for p in head["pieces"]] + ([int(head["few"].arrays[0].min())] if head["few"] is not None else []), default=None)
            if waits is None or waits - state[1] > idle:
                if self.closing:
                    ended.append(self._close(key, state))
                state = None
        head["state"] = state
        self._store(head)
        if ended:
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, map(list, zip(*ended)))})

    def close(self):
        pass


def _run(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], rule, keep: Sequence[str], delay: str, idle: str | None, closing: bool) -> DataFrame:
    keys, keep, tie = list(keys), list(keep), list(tie)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
    need = list(dict.fromkeys([*tie, *rule.inputs, *keep]))
    us = lambda c: F.unix_micros(c) if c in times else F.col(c)
    x = (df.where(F.col(time).isNotNull()).withWatermark(time, delay)
         .select(*keys, F.col(time).alias("at_time"), F.unix_micros(time).alias("at_us"), *[us(c).alias(f"in_{c}") for c in need]))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    # names without a leading underscore: the batches that reach the processor would lose them
    columns = ["at_us", *[f"in_{c}" for c in need]]

    class Renamed:
        inputs = [f"in_{c}" for c in rule.inputs]
        init, advance = staticmethod(rule.init), staticmethod(rule.advance)
        closing = staticmethod(getattr(rule, "closing", lambda state: ()))

    if closing:
        schema = [f"`{c}` {kinds[c]}" for c in keys] + ["opened bigint", "last bigint", rule.closes]
        names = [*keys, "opened", "last", *[p.split()[0] for p in rule.closes.split(", ")]]
    else:
        schema = [f"`in_{c}` {kinds['in_' + c]}" for c in keep] + [rule.outputs]
        names = [f"in_{c}" for c in keep] + [p.split()[0] for p in rule.outputs.split(", ")]
    span = None if idle is None else df.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00+00:00' + INTERVAL {idle})").first()[0]
    proc = _Ordered(columns, [kinds[c] for c in columns], ["at_us", *[f"in_{c}" for c in tie]], Renamed, [f"in_{c}" for c in keep], names, span, closing)
    out = x.groupBy(*keys).transformWithStateInPandas(proc, outputStructType=", ".join(schema), outputMode="append", timeMode="eventTime")
    if closing:
        return out.withColumns({"opened": F.timestamp_micros("opened"), "last": F.timestamp_micros("last")})
    back = lambda c: F.timestamp_micros(f"in_{c}") if c in times else F.col(f"in_{c}")
    return out.select(*[back(c).alias(c) for c in keep], *names[len(keep):])


def ordered_rule(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], rule, keep: Sequence[str], delay: str = "10 minutes",
                 idle: str | None = None) -> DataFrame:
    """A rule over a stream in event-time order (ties by `tie`), whatever the order of arrival: one row per input row up
    to the watermark, with the `keep` columns and the rule's outputs. Rows without a time are left out. `delay` is the
    watermark's; `idle` ('1 hour') starts a key anew after a longer silence."""
    return _run(df, keys, time, tie, rule, keep, delay, idle, False)


def silent_keys(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], rule, idle: str, delay: str = "10 minutes") -> DataFrame:
    """One row per key and activity once the key has been silent for longer than `idle`: keys, `opened`, `last`, and the
    rule's closing outputs. A timer emits the row and clears the state when the watermark has passed; a key that
    returns later starts anew."""
    return _run(df, keys, time, tie, rule, [], delay, idle, True)


def arrivals(df: DataFrame, path: str, arrival: Column, batches: int) -> str:
    """A table as `batches` files in the order of `arrival`, for replays with late rows: equal spans of arrival time, one
    file each, written one after the other, as a file stream reads them."""
    x = df.withColumn("_a", F.unix_micros(arrival))
    lo, hi = x.agg(F.min("_a"), F.max("_a")).first()
    for b in range(batches):
        part = F.least(F.floor((F.col("_a") - lo) * batches / F.greatest(F.lit((hi or 0) - (lo or 0)), F.lit(1))), F.lit(batches - 1))
        x.where(part == b).drop("_a").coalesce(1).write.mode("append").parquet(path)
    return path
