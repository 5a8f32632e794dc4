"""Retention: nothing is released that its copy does not hold."""

import glob
import os

import pytest

from stagecast.streaming import retention as r

SCHEMA = "gauge_id string, value double, note map<string,string>"
ROWS = [("a", 1.0, {"k": "v"}, "2026-01-01"), ("a", 1.0, {"k": "v"}, "2026-01-01"), ("b", None, None, "2026-01-02"), ("c", 3.0, {}, "2026-02-01")]


def store(spark, path, rows):
    spark.createDataFrame(rows, f"{SCHEMA}, day string").write.mode("append").partitionBy("day").parquet(path)


def days(path):
    return sorted(n for n in os.listdir(path) if n.startswith("day="))


@pytest.fixture
def places(spark, tmp_path):
    path, archive = str(tmp_path / "table"), str(tmp_path / "archive")
    store(spark, path, ROWS)
    return path, archive


def call(fn, spark, places, *more):
    path, archive = places
    return fn(spark, path, archive, "first", SCHEMA, "day", *more)


def test_export_then_release(spark, places):
    listed = {x.day: x.rows for x in call(r.export, spark, places, "2026-02-01").collect()}
    assert listed == {"2026-01-01": 2, "2026-01-02": 1}
    assert days(places[0]) == ["day=2026-01-01", "day=2026-01-02", "day=2026-02-01"]
    assert set(call(r.release, spark, places).values()) == {"release"}
    assert days(places[0]) == ["day=2026-02-01"]
    assert call(r.release, spark, places) == {"2026-01-01": "gone", "2026-01-02": "gone"}
    kept = r.exported(spark, places[1], "first", SCHEMA, "day").collect()
    assert sorted((x.gauge_id, x.day) for x in kept) == [("a", "2026-01-01"), ("a", "2026-01-01"), ("b", "2026-01-02")]


def test_rows_that_come_later_stay(spark, places):
    call(r.export, spark, places, "2026-02-01")
    store(spark, places[0], [("late", 2.0, None, "2026-01-01")])
    assert call(r.release, spark, places) == {"2026-01-01": "changed since", "2026-01-02": "release"}
    assert days(places[0]) == ["day=2026-01-01", "day=2026-02-01"]


def test_a_damaged_copy_is_refused(spark, places):
    call(r.export, spark, places, "2026-02-01")
    for name in glob.glob(f"{places[1]}/first/data/day=2026-01-01/*.parquet"):
        os.remove(name)
    store(spark, f"{places[1]}/first/data", [("a", 1.0, {"k": "w"}, "2026-01-01"), ("a", 1.0, {"k": "v"}, "2026-01-01")])
    assert call(r.release, spark, places) == {"2026-01-01": "damaged copy", "2026-01-02": "release"}
    assert "day=2026-01-01" in days(places[0])


def test_an_unfinished_export_releases_nothing(spark, places):
    path, archive = places
    store(spark, f"{archive}/first/data", ROWS[:3])
    with pytest.raises(Exception):
        call(r.release, spark, places)
    assert len(days(path)) == 3


def test_empty_export(spark, places):
    assert call(r.export, spark, places, "2020-01-01").count() == 0
    assert call(r.release, spark, places) == {}
