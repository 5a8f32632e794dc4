"""Deliveries that land for the streamed queries."""

import os

from stagecast.queries import streams


def test_a_delivery_is_landed_by_all_cores(spark, tmp_path):
    rows = spark.range(400, numPartitions=2).selectExpr("cast(id AS string) AS value")
    path = str(tmp_path / "landing")
    files = streams._land(rows, path)
    cores = spark.sparkContext.defaultParallelism
    assert cores == 4 and files == len([n for n in os.listdir(path) if n.startswith("part-")]) == cores
    assert sorted(int(r.value) for r in spark.read.text(path).collect()) == list(range(400))
    assert streams._land(rows.limit(1), str(tmp_path / "small")) == files
