"""Registration helper and the SQL twins of the shared frames."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import TimestampType

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_LINES = """select {sym} symbol, l_shipdate ts, l_extendedprice / l_quantity price, l_quantity::bigint volume,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem"""
_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_BARS = """select symbol, {ts} ts, first(price order by {seq}) open, max(price) high, min(price) low,
  last(price order by {seq}) AS close, sum(volume)::bigint volume from {src} group by all"""

CTES: dict[str, str] = {
    "tk": "select event_type symbol, ts, event_id, value + 10 price, event_id % 100 + 1 volume from events",
    "hb": _BARS.format(ts="date_trunc('hour', ts)", seq="ts, event_id", src="tk"),
    "db": _BARS.format(ts="date_trunc('day', ts)::timestamp", seq="ts, event_id", src="tk"),
    "pl": _LINES.format(sym="l_returnflag"),
    "pb": _BARS.format(ts="ts", seq=_SEQ, src="pl"),
    "sl": _LINES.format(sym="'S' || l_suppkey"),
    "sb": _BARS.format(ts="ts", seq=_SEQ, src="sl"),
    "hr": """select * from (select symbol, ts, ln(close / lag(close) over (partition by symbol order by ts)) ret from hb)
  where ret is not null""",
    "pr": """select * from (select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 ret from pb)
  where ret is not null""",
    "sr": """select * from (select symbol, ts, ln(close / lag(close) over (partition by symbol order by ts)) ret from sb)
  where ret is not null""",
    "br": "select ts, avg(ret) bench_ret from pr group by ts",
    "pos": """select o_custkey portfolio, 'S' || l_suppkey symbol, sum(l_quantity) quantity,
  sum(l_extendedprice) / sum(l_quantity) avg_price from lineitem join orders on l_orderkey = o_orderkey group by all""",
    "tr": """select o_custkey portfolio, 'S' || l_suppkey symbol, l_shipdate ts,
  case when l_returnflag = 'R' then 'sell' else 'buy' end AS action, l_quantity quantity, l_extendedprice / l_quantity price,
  row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) seq
  from lineitem join orders on l_orderkey = o_orderkey""",
    "dk": "select *, row_number() over (partition by symbol order by ts) k from hb",
    "d0": """select symbol, ts, k, case when k % 31 = 0 then null else open end AS open,
  case when k % 37 = 0 then low - 1 when k % 41 = 0 then null else high end AS high,
  case when k % 43 = 0 then high + 1 when k % 53 = 0 then -low else low end AS low,
  case when k % 29 = 0 then null when k % 97 = 0 then close * 25 else close end AS close,
  case when k % 23 = 0 then null when k % 61 = 0 then 0 when k % 67 = 0 then -5 else volume end AS volume from dk""",
    "dd": "select * from d0 union all by name select * replace (k + 100000 AS k) from d0 where k % 47 = 0",
    "st": "select user_id entity, ts, event_id, event_type state from events",
}
_NEEDS = {"hb": "tk", "db": "tk", "pb": "pl", "sb": "sl", "hr": "hb", "pr": "pb", "sr": "sb", "br": "pr",
          "dk": "hb", "d0": "dk", "dd": "d0"}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        if n in out:
            return
        for d in _NEEDS.get(n, "").split():
            add(d)
        out.append(n)

    for n in names:
        add(n)
    return out


def sql(frames: str, body: str, **ctes: str) -> str:
    """`body` with the named shared frames and extra CTEs in front."""
    parts = [f"{n} AS ({CTES[n]})" for n in _closure(frames.split())] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def register(name: str, run: Callable, oracle: str | None = None, digits: str | dict | None = None) -> None:
    """Register a query. `digits` ("a b:9": 6 places unless given) rounds columns alike on both sides."""
    if isinstance(digits, str):
        digits = {c.split(":")[0]: int((c.split(":") + ["6"])[1]) for c in digits.split()}
    digits = digits or {}

    def wrapped(spark, root) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = run(spark, root)
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, TimestampType):
                c = c.cast("timestamp_ntz")
            if f.name in digits:
                c = F.round(c.cast("double"), digits[f.name]) + F.lit(0.0)
            cols.append(c.alias(f.name))
        return df.select(*cols)

    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = wrapped
    if oracle:
        if digits:
            rep = ", ".join(f'round("{c}"::double, {d}) + 0.0 AS "{c}"' for c, d in digits.items())
            oracle = f"SELECT * REPLACE ({rep}) FROM ({oracle})"
        ORACLES[name] = oracle
