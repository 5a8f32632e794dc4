"""Compaction: the same rows before, during and after, replays, late rows, bounded folders."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_sources import revision

from stagecast.schemas import REVISION
from stagecast.streaming import compaction as sc
from stagecast.streaming import ingest as si


def store(spark, root, batch, *rows):
    si.ingest(spark.createDataFrame(list(rows), REVISION), "direct", root, batch_id=batch)


def rows(spark, root):
    return sorted((r.gauge_id, r.event_time, r.payload_hash) for r in si.revisions_table(spark, root).collect())


def folders(root, month):
    path = f"{root}/revisions/parameter_code=00065/event_month={month}"
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(4):
        store(spark, root, batch, *[revision(gauge=g, payload=f"{m}{batch}", at=datetime(2026, m, 1 + batch)) for m in (1, 2, 3) for g in "ab"])
    return root


def test_rows_stay_the_same(spark, root):
    before, marks = rows(spark, root), sorted(si.high_water_table(spark, root).collect())
    assert sc.compact(spark, root) == 1
    assert rows(spark, root) == before and len(before) == 24
    assert sc.release(spark, root) == 12  # 2 closed months x 4 batches, 4 folders of marks
    assert rows(spark, root) == before
    assert sorted(si.high_water_table(spark, root).collect()) == marks
    assert not any("batch" in n for n in folders(root, "2026-01")) and len(folders(root, "2026-03")) == 4
    assert sc.compact(spark, root) is None
    packed = f"{root}/compacted/v=1/parameter_code=00065/event_month=2026-01"
    assert len([n for n in os.listdir(packed) if n.endswith(".parquet")]) == 1


def test_small_files_are_packed_to_a_size(spark, root):
    before = rows(spark, root)
    sc.compact(spark, root, open_months=0, file_size=2000)
    packed = f"{root}/compacted/v=1/parameter_code=00065/event_month=2026-01"
    assert len([n for n in os.listdir(packed) if n.endswith(".parquet")]) > 1
    assert rows(spark, root) == before


def test_a_version_without_its_pointer_is_not_read(spark, root):
    before = rows(spark, root)
    real = sc.POINTER
    sc.POINTER = "this is no schema"
    try:
        with pytest.raises(Exception):
            sc.compact(spark, root)
    finally:
        sc.POINTER = real
    assert os.path.isdir(f"{root}/compacted/v=1") and sc.versions(spark, root) == []
    assert rows(spark, root) == before
    assert sc.compact(spark, root) == 1
    assert rows(spark, root) == before


@pytest.mark.parametrize("released", [False, True])
def test_replays_and_late_rows(spark, root, released):
    before = rows(spark, root)
    sc.compact(spark, root)
    if released:
        sc.release(spark, root)
    store(spark, root, 1, *[revision(gauge=g, payload="11", at=datetime(2026, 1, 2)) for g in "ab"])
    store(spark, root, 9, revision(gauge="a", payload="10", at=datetime(2026, 1, 1)))
    assert rows(spark, root) == before
    store(spark, root, 10, revision(gauge="a", payload="late", at=datetime(2026, 1, 1)))
    after = sorted([*before, ("a", datetime(2026, 1, 1), "late")])
    assert rows(spark, root) == after
    assert sc.compact(spark, root) == 2
    sc.release(spark, root)
    assert rows(spark, root) == after
    assert not any("batch" in n for n in folders(root, "2026-01"))
    assert si.high_water_table(spark, root).count() == 2


def test_next_batch_follows_the_compacted_ones(spark, root):
    sc.compact(spark, root)
    sc.release(spark, root)
    si.ingest(spark.createDataFrame([revision(gauge="c", payload="n", at=datetime(2026, 3, 9))], REVISION), "direct", root)
    assert "batch_id=4" in folders(root, "2026-03")


def test_a_month_is_not_drawn_into_one_task(spark):
    readings = [revision(gauge="a", payload=str(i), at=datetime(2026, 1 + i % 2, 1, i % 24, i // 24)) for i in range(400)]
    stored = spark.createDataFrame(readings, REVISION).selectExpr("*", "date_format(event_time, 'yyyy-MM') AS event_month")
    sizes = stored.groupBy("parameter_code", "event_month").agg(F.lit(1000).cast("bigint").alias("bytes"))
    dealt = sc.spread_months(stored, sizes, 300)
    found = dealt.groupBy(F.spark_partition_id().alias("task"), "event_month").agg(F.count("*").alias("n")).collect()
    # four files a month, each in a task of its own
    assert len(found) == len({r.task for r in found}) == 8 and sum(r.n for r in found) == 400
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(parameter_code" not in plan
