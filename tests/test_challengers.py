"""Live challengers: records, failures, and cycles that run again."""

import pytest
from pyspark.sql import functions as F

from stagecast.operators import boosting
from stagecast.operators.features import live_histories
from stagecast.plans import challengers
from stagecast.session import scratch

LOOKBACK, HORIZONS = 4, (1, 6)


@pytest.fixture(scope="module")
def tables(spark):
    series = [("whole", i, 10.0 + i % 3) for i in range(12)] + [("gap", i, 5.0) for i in range(12) if i != 6]
    series += [("new", i, 1.0) for i in range(8)] + [("longer", i, 2.0) for i in range(8)]
    cuts = []
    for name in ("whole", "gap", "longer"):
        for h in HORIZONS:
            cuts.append((name, h, 0, 1, 0, float("inf"), 0.5 * h, 0.5 * h))
            cuts.append((name, h, 1, 1, 0, 0.0, -1.0, 1.0))
            cuts.append((name, h, 1, 3, 1, 0.0, 4.0, 8.0))
    kind = "target_id string, horizon int, tree int, node int, feature int, threshold double, left double, right double"
    ensemble = spark.createDataFrame(cuts, kind)
    residuals = spark.createDataFrame(
        [(n, h, q, r) for n in ("whole", "gap", "longer") for h in HORIZONS for q, r in ((0.05, -100.0), (0.5, 0.25))],
        "target_id string, horizon int, probability double, residual double",
    )
    fitted = challengers.lookbacks(ensemble, LOOKBACK).withColumn("lookback", F.when(F.col("target_id") == "longer", 9).otherwise(F.col("lookback")))
    return spark.createDataFrame(series, "series string, idx long, value double"), ensemble, residuals, fitted


def expected(history, h):
    rel = [v - history[-1] for v in history]
    centre = history[-1] + 0.5 * h + (-1.0 if rel[0] <= 0 else 4.0 if rel[1] <= 0 else 8.0)
    return {0.05: max(0.0, centre - 100), 0.5: max(0.0, centre + 0.25)}


def cycle(spark, tables, issues):
    series, ensemble, residuals, fitted = tables
    wanted = spark.createDataFrame(issues, "target_id string, issued_idx long")
    return challengers.cycle(series, wanted, ensemble, residuals, fitted, LOOKBACK, horizons=HORIZONS)


def test_records_and_failures(spark, tables):
    issues = [("whole", 6), ("whole", 7), ("whole", 8), ("gap", 6), ("gap", 9), ("new", 6), ("longer", 7), ("unknown", 3)]
    found = cycle(spark, tables, issues)
    got = {}
    for r in found["records"].collect():
        assert r.input_ends_idx == r.issued_idx - 1
        got.setdefault((r.target_id, r.issued_idx, r.horizon), {})[r["quantile"]] = r.value
    values = [10.0 + i % 3 for i in range(12)]
    want = {("whole", i, h): expected(values[i - 4 : i], h) for i in (6, 7, 8) for h in HORIZONS}
    want |= {("gap", 6, h): expected([5.0] * 4, h) for h in HORIZONS}
    assert got == want
    failures = {(r.target_id, r.issued_idx): (r.model, r.reason, r.first_missing_idx) for r in found["failures"].collect()}
    assert failures == {
        ("gap", 9): (None, "incomplete history", 6),
        ("new", 6): ("boosted_trees", "no model", None),
        ("longer", 7): ("boosted_trees", "other history length", None),
        ("unknown", 3): (None, "incomplete history", -1),
    }


def test_a_cycle_that_runs_again_adds_nothing(spark, tables):
    folder = scratch(spark, "challengers")
    first = cycle(spark, tables, [("whole", 6), ("gap", 9), ("new", 6)])
    assert challengers.append_cycle(first, folder) == {"records": 4, "failures": 2}
    assert challengers.append_cycle(first, folder) == {"records": 0, "failures": 0}
    more = cycle(spark, tables, [("whole", 6), ("whole", 7), ("gap", 9)])
    assert challengers.append_cycle(more, folder) == {"records": 4, "failures": 0}
    assert spark.read.parquet(f"{folder}/records").count() == 8


def test_histories_over_block_borders(spark):
    series = spark.createDataFrame([("s", i, float(i)) for i in range(-9, 40) if i not in (3, 20, 21)] + [("s", 3, None)], "series string, idx long, value double")
    issues = spark.createDataFrame([("s", i) for i in range(-9, 45)] * 2, "series string, issued_idx long")
    known = set(range(-9, 40)) - {3, 20, 21}
    for width in (5, 7, 4096):
        found = live_histories(series, issues, 5, width).collect()
        assert len(found) == 54
        for r in found:
            steps = range(r.issued_idx - 5, r.issued_idx)
            missing = [i for i in steps if i not in known]
            assert r.history == (None if missing else [float(i) for i in steps])
            assert r.first_missing_idx == (missing[0] if missing else None)


def test_comparison(spark):
    kind = "target_id string, variant string, mae_1 double, mae_6 double, mae_24 double, high_stage_mae double"
    ridge = spark.createDataFrame([("a", "target_only", 1.0, 1.0, 1.0, 1.0), ("a", "target_plus_upstream", 0.1, 0.1, 0.1, 0.1)], kind)
    trees = spark.createDataFrame([("a", "boosted_trees", 0.98, 0.97, 0.96, 1.01)], kind)
    (row,) = challengers.comparison(ridge, trees, ("2018-01-01", "2020-12-31")).collect()
    assert row.promotion_allowed and row.champion_mae_6 == 1.0 and row.mae_6 == 0.97
    assert (row.first_day, row.last_day, row.held_out_test_used) == ("2018-01-01", "2020-12-31", False)
    worse = spark.createDataFrame([("a", "boosted_trees", 1.06, 0.8, 0.8, 0.8)], kind)
    assert not challengers.comparison(ridge, worse, ("", "")).first().promotion_allowed
