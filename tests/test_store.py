"""Versions, upserts that die, conflicts, pruning and compaction of the versioned store."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources.store import VersionConflict, VersionedStore

SCHEMA = "symbol string, ts timestamp, close double, month int"


def at(day, month=1):
    return dt.datetime(2024, month, day)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select("symbol", F.date_format("ts", "MM-dd"), "close", "month").collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    st = VersionedStore(spark, str(tmp_path / "s"), ["month"], ["symbol", "ts"])
    st.append(frame(spark, [("A", at(1), 1.0, 1), ("B", at(1), 2.0, 1), ("A", at(1, 2), 3.0, 2), (None, None, 9.0, None)]))
    return st


def test_upsert_replaces_its_keys_only_and_old_versions_stay(spark, store):
    before = rows_of(store.read())
    assert store.upsert(frame(spark, [("A", at(1), 5.0, 1), ("C", at(2), 6.0, 1), (None, None, 8.0, None)]), ["symbol", "ts"]) == 2
    assert rows_of(store.read()) == sorted([("A", "01-01", 5.0, 1), ("B", "01-01", 2.0, 1), ("C", "01-02", 6.0, 1), ("A", "02-01", 3.0, 2),
                                            (None, None, 8.0, None)], key=str)
    assert rows_of(store.read(1)) == before
    assert not store._names(f"{store.path}/staging")


def test_pinned_reader_is_not_moved_by_later_commits(spark, store):
    pinned = store.read()
    before = rows_of(pinned)
    store.append(frame(spark, [("Z", at(3), 7.0, 1)]))
    assert rows_of(pinned) == before and len(rows_of(store.read())) == len(before) + 1


def test_a_load_that_dies_leaves_the_version(spark, store):
    before = rows_of(store.read())
    bad = frame(spark, [("A", at(1), 5.0, 1), ("Q", at(1, 2), 5.0, 2)]).withColumn(
        "close", F.when(F.col("symbol") == "Q", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad, ["symbol", "ts"])
    with pytest.raises(Exception, match="lost"):
        store.append(bad)
    assert store.versions() == [1] and rows_of(store.read()) == before


def test_two_writers_of_one_version(spark, store):
    base = store._manifest(None)
    store.append(frame(spark, [("Z", at(3), 7.0, 1)]))
    kept = rows_of(store.read())
    with pytest.raises(VersionConflict):
        store._commit(base, [], store.read().schema)
    assert store.versions() == [1, 2] and rows_of(store.read()) == kept
    assert all(not n.startswith("_") for n in store._names(f"{store.path}/manifest"))


def test_repeated_keys_need_a_deciding_column(spark, store):
    twice = frame(spark, [("A", at(1), 5.0, 1), ("A", at(1), 6.0, 1)])
    with pytest.raises(Exception, match="repeated key"):
        store.upsert(twice, ["symbol", "ts"])
    store.upsert(twice, ["symbol", "ts"], newest="close")
    assert ("A", "01-01", 6.0, 1) in rows_of(store.read()) and ("A", "01-01", 5.0, 1) not in rows_of(store.read())


def test_month_filter_prunes_folders(spark, store):
    df = store.read().where("month = 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert [f.rsplit("/", 2)[1] for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]] == ["month=2"]


def test_compaction_and_vacuum(spark, store):
    store.append(frame(spark, [("Z", at(3), 7.0, 1), ("Z", at(3), 7.0, 1)]))
    before = rows_of(store.read())
    assert store.compact() == 3 and rows_of(store.read()) == before
    assert store.compact() is None and len(store._manifest(None)["entries"]) == 3
    assert store.vacuum(1) == [1, 2] and rows_of(store.read()) == before
    with pytest.raises(ValueError, match="version 1"):
        store.read(1)


def test_empty_loads_and_other_columns(spark, tmp_path):
    st = VersionedStore(spark, str(tmp_path / "e"), ["month"])
    with pytest.raises(ValueError, match="no version"):
        st.read()
    assert st.append(frame(spark, [])) == 1 and st.read().count() == 0
    assert st.upsert(frame(spark, []), ["symbol"]) == 2 and st.read().columns == ["symbol", "ts", "close", "month"]
    with pytest.raises(ValueError, match="columns differ"):
        st.append(frame(spark, []).withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="missing partition"):
        st.append(frame(spark, []).drop("month"))


def test_month_store_query_shuffles_its_bars_once(spark, monkeypatch):
    from tidemark.catalog import models
    from tidemark.plans import frames
    asked, one = [], frames.suppliers
    monkeypatch.setattr(frames, "suppliers", lambda s, d: asked.append(one(s, d)) or asked[-1])
    sources = []
    monkeypatch.setattr(models, "market_store", lambda s, p: type("Store", (), {"append": lambda _, df: sources.append(df), "upsert": lambda _, df, k: sources.append(df), "compact": lambda _: None})())
    models._stored(spark, "/root/testdata/sf0.001")
    assert len(sources) == 3 and all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in sources)
    assert sources[0].count() + sources[1].count() == asked[0].count()
