import random
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from stagecast.constants import HOUR
from stagecast.operators import coverage, series
from stagecast.operators.blocks import every_nth, numbered
from stagecast.operators.quantiles import exact_quantiles
from stagecast.operators.revisions import (
    BY_TIME,
    advance_high_water,
    canonical,
    high_water,
    new_revisions,
    newest,
    revision_statistics,
)

START = datetime(2024, 1, 1)
OBS = """source string, time_series_id string, gauge_id string, parameter_code string,
    event_time timestamp_ntz, value double, ingested_at timestamp_ntz, payload_hash string"""


def obs(minute, value, seen, payload, gauge="g"):
    at = START + timedelta(minutes=minute)
    return ("usgs", f"s-{gauge}", gauge, "00065", at, value, START + timedelta(minutes=seen), payload)


def test_newest_revision_wins_even_when_it_withdraws_the_value(spark):
    rows = spark.createDataFrame([obs(0, 1.0, 1, "a"), obs(0, None, 2, "b"), obs(15, 2.0, 1, "c")], OBS)
    got = {r.event_time: r.value for r in canonical(rows).collect()}
    assert got == {START: None, START + timedelta(minutes=15): 2.0}
    kept = {r.event_time: r.value for r in canonical(rows, BY_TIME, True).collect()}
    assert kept[START] == 1.0


def test_corrections_do_not_use_up_the_limit(spark):
    rows = [obs(15 * i, float(i), s, f"{i}-{s}") for i in range(5) for s in (1, 2, 3)]
    got = newest(spark.createDataFrame(rows, OBS), 3).collect()
    assert sorted(r.value for r in got) == [2.0, 3.0, 4.0]


def test_one_hot_identity_leaves_one_row(spark):
    rows = spark.createDataFrame([obs(0, float(i), i, str(i)) for i in range(5000)], OBS)
    assert [r.value for r in canonical(rows).collect()] == [4999.0]
    plan = canonical(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_repeated_revisions_in_one_call_are_stored_once(spark):
    incoming = spark.createDataFrame([obs(0, 1.0, 1, "a")] * 3 + [obs(0, 1.1, 2, "b")], OBS)
    stored = spark.createDataFrame([obs(0, 1.1, 2, "b")], OBS)
    assert [r.payload_hash for r in new_revisions(incoming, stored).collect()] == ["a"]


def test_statistics_and_high_water(spark):
    rows = spark.createDataFrame([obs(0, 1.0, 1, "a"), obs(0, 1.0, 1, "a"), obs(0, 2.0, 2, "b"), obs(15, 1.0, 1, "c")], OBS)
    got = revision_statistics(rows).first()
    assert (got.revision_rows, got.duplicate_revision_rows, got.observation_times_with_revisions) == (4, 1, 1)
    later = high_water(rows)
    assert advance_high_water(later, rows.where("value = 2.0")).first().event_time == START + timedelta(minutes=15)


def test_hourly_means_leave_missing_hours_out(spark):
    rows = spark.createDataFrame([obs(0, 1.0, 1, "a"), obs(30, 3.0, 1, "b"), obs(150, 5.0, 1, "c")], OBS)
    got = {r.idx: r.value for r in series.step_means(rows).collect()}
    first = int(START.timestamp()) // 3600
    assert got == {first: 2.0, first + 2: 5.0}
    dense = {r.idx: r.value for r in series.densify(series.step_means(rows), width=2).collect()}
    assert dense == {first: 2.0, first + 1: None, first + 2: 5.0}


def test_five_minute_readings_count_once_per_quarter_hour(spark):
    rows = spark.createDataFrame([obs(m, 1.0, 1, str(m)) for m in (0, 5, 10, 15)], OBS)
    assert series.quarter_hour_coverage(rows, 2).first().coverage == 1.0


def test_gaps_inside_and_across_blocks(spark):
    rows = spark.createDataFrame([obs(60 * h, 1.0, 1, str(h)) for h in (0, 1, 26)], OBS)
    for width in (HOUR, 7 * HOUR, 1000 * HOUR):
        got = series.gap_summary(rows, width=width).first()
        assert (got.over_30_minutes, got.over_24_hours, got.longest_hours) == (2, 1, 25.0)


def test_changes_need_the_exact_previous_step(spark):
    rows = spark.createDataFrame([("s", i, float(i * i)) for i in (0, 1, 2, 5, 6)], "series string, idx bigint, value double")
    for width in (2, 3, 100):
        got = {r.idx: r.change for r in series.step_changes(rows, width=width).collect()}
        assert got == {1: 1.0, 2: 3.0, 6: 11.0}


def test_coverage_covers_empty_months(spark):
    rows = spark.createDataFrame([obs(0, 1.0, 1, "a")], OBS)
    got = coverage.monthly_coverage(rows, rows, date(2024, 1, 31), date(2024, 3, 1)).collect()
    assert sorted((str(r.month), r.observed, r.expected) for r in got) == [
        ("2024-01-01", 1, 96), ("2024-02-01", 0, 29 * 96), ("2024-03-01", 0, 96),
    ]


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = random.Random(5)
    groups = {
        "spread": [rng.uniform(-1000, 1000) for _ in range(501)],
        "same": [2.5] * 40,
        "near zero": [rng.gauss(0, 1e-5) for _ in range(200)],
        "outlier": [rng.uniform(4, 5) for _ in range(300)] + [1e12],
        "one": [7.0],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    probabilities = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    got = exact_quantiles(rows, ["k"], "v", probabilities).collect()
    assert len(got) == len(groups) * len(probabilities)
    for r in got:
        assert np.isclose(r.quantile, np.quantile(groups[r.k], r.probability), rtol=1e-12, atol=1e-15)
        assert r.group_size == len(groups[r.k])


def test_numbering_and_thinning_run_across_blocks(spark):
    rows = spark.createDataFrame([("s", 3 * i) for i in range(100)] + [("t", i) for i in range(5)], "k string, i bigint")
    got = {(r.k, r.i): r.row_index for r in numbered(rows, ["k"], "i", 16).collect()}
    assert got == {**{("s", 3 * i): i for i in range(100)}, **{("t", i): i for i in range(5)}}
    assert every_nth(rows, ["k"], "i", 12, 16).count() == 9 + 1
