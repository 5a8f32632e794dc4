from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecast.constants import HORIZONS, HOUR
from stagecast.operators import features as x
from stagecast.operators import models as m
from stagecast.operators import upstream as u
from stagecast.operators.series import step_changes
from stagecast.plans.shadow import challenger_inputs

SERIES = "series string, idx bigint, value double"


def ramp(spark, name, n, offset=0.0, skip=()):
    return spark.createDataFrame([(name, i, float(i) + offset) for i in range(n) if i not in skip], SERIES)


def test_tabular_features_are_causal(spark):
    lags = spark.createDataFrame([("t", "up", 1)], "target_id string, gauge_id string, lag_hours int")
    for width in (10, 1024):
        rows = x.horizon_examples(ramp(spark, "t", 75), width=width)
        got = x.add_upstream(rows, ramp(spark, "up", 75, 100.0), lags).orderBy("idx").first()
        assert (got.idx, got.target_stage_ft, got.target_change_1h_ft, got.upstream) == (1, 1.0, 1.0, [100.0])
        assert [got[y] for y in x.label_names()] == [2.0, 7.0, 25.0, 49.0, 73.0]
    assert x.upstream_names([("up", 1)]) == ["upstream_up_cfs_lag_1h"]


def test_a_missing_lagged_value_drops_the_row(spark):
    lags = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "target_id string, gauge_id string, lag_hours int")
    rows = x.horizon_examples(ramp(spark, "t", 80))
    up = ramp(spark, "a", 80).unionByName(ramp(spark, "b", 80, skip=(2,)))
    got = sorted(r.idx for r in x.add_upstream(rows, up, lags).collect())
    assert got == [2, 3, 5, 6, 7]


def test_nothing_after_the_issue_changes_the_features(spark):
    base = x.horizon_examples(ramp(spark, "t", 90), width=16).where("idx = 10").first()
    later = ramp(spark, "t", 90).withColumn("value", F.when(F.col("idx") > 10, -F.col("value")).otherwise(F.col("value")))
    changed = x.horizon_examples(later, width=16).where("idx = 10").first()
    assert (base.target_stage_ft, base.target_change_1h_ft) == (changed.target_stage_ft, changed.target_change_1h_ft)


@pytest.mark.parametrize("width", [5, 4096])
def test_sequences(spark, width):
    got = x.sequence_examples(ramp(spark, "t", 80), 4, width=width).orderBy("issued_idx").first()
    assert (got.issued_idx, got.history) == (4, [0.0, 1.0, 2.0, 3.0])
    assert [got[y] for y in x.label_names()] == [5.0, 10.0, 28.0, 52.0, 76.0]
    gap = x.sequence_examples(ramp(spark, "t", 80, skip=(2,)), 4, width=width).orderBy("issued_idx").first()
    assert gap.history == [3.0, 4.0, 5.0, 6.0]


OBS = """source string, time_series_id string, gauge_id string, parameter_code string, event_time timestamp,
    value double, ingested_at timestamp, payload_hash string"""


def live(spark, hours):
    start = datetime(2026, 1, 2, 8)
    rows = [("t", "s", "g", "00065", start + timedelta(hours=h), float(h), start, str(h)) for h in hours]
    targets = spark.createDataFrame([("g",)], "target_id string")
    return challenger_inputs(spark.createDataFrame(rows, OBS), targets, datetime(2026, 1, 2, 12, 30), 4)


def test_live_history_uses_elapsed_hours_only(spark):
    got = live(spark, range(5))["histories"].first()
    assert got.history == [0.0, 1.0, 2.0, 3.0]
    assert got.input_ends_idx * HOUR == int(datetime(2026, 1, 2, 11).timestamp()) * 1_000_000


def test_live_history_rejects_a_gap(spark):
    got = live(spark, (0, 1, 3))
    assert got["histories"].count() == 0
    failure = got["failures"].first()
    assert failure.reason == "incomplete history" and str(failure.first_missing_at).startswith("2026-01-02 10:00:00")


@pytest.mark.parametrize("width", [7, 4096])
def test_thinning_keeps_every_nth_example_with_its_history(spark, width):
    def split(df):
        return df.withColumn("split", F.when(F.col("issued_idx") < 30, "a").when(F.col("issued_idx") > 40, "b")).where("split IS NOT NULL")

    series = ramp(spark, "t", 160, skip=(17, 55)).unionByName(ramp(spark, "u", 110))
    whole = {"t": {"a": [], "b": []}, "u": {"a": [], "b": []}}
    for r in split(x.sequence_examples(series, 4)).orderBy("issued_idx").collect():
        whole[r.target_id][r.split].append((r.issued_idx, r.history, [r[y] for y in x.label_names()]))
    wanted = {(k, s, *map(str, v)) for k, by in whole.items() for s, rows in by.items() for v in rows[::3]}
    got = x.thinned_examples(series, 3, split, 4, width=width).collect()
    found = {(r.target_id, r.split, *map(str, (r.issued_idx, r.history, [r[y] for y in x.label_names()]))) for r in got}
    assert found == wanted and len(got) == len(wanted) > 20


def test_scales_and_normalisation(spark):
    rows = x.sequence_examples(ramp(spark, "t", 120), 4)
    scales = x.sequence_scales(rows).first()
    history = np.array([-3.0, -2.0, -1.0, 0.0])
    assert np.isclose(scales.input_scale, history.std()) and scales.target_scale_1 == 1.0
    got = x.normalise_sequences(rows, x.sequence_scales(rows)).first()
    assert np.allclose(got.x, history / history.std()) and got.y[0] == 2.0


def test_normalisation_keeps_every_split(spark):
    from stagecast.queries import REGISTRY

    rows = x.sequence_examples(ramp(spark, "t", 120), 4)
    rows = rows.withColumn("split", F.when(F.col("issued_idx") % 2 == 0, "training").otherwise("calibration"))
    got = x.normalise_sequences(rows, x.sequence_scales(rows), keep=["split"])
    assert got.count() == rows.count() and {r.split for r in got.collect()} == {"training", "calibration"}
    sql = REGISTRY["normalised_examples"][1]  # compares both arrays of every split
    assert "split = 'validation'" not in sql and " AS x" in sql and "] AS y" in sql


def test_lag_sweep_finds_the_travel_time(spark):
    level = {i: 100.0 + (i % 13) ** 2 for i in range(1600)}
    rows = [("up", i, v) for i, v in level.items()] + [("t", i + 7, 4 + v / 100) for i, v in level.items()]
    df = spark.createDataFrame(rows, SERIES)
    links = spark.createDataFrame([("t", "up")], "target_id string, gauge_id string")
    for width in (100, 5000):
        sweep = u.lag_sweep(
            step_changes(df.where("series = 'up'"), log=True), step_changes(df.where("series = 't'")),
            links, 12, 100, width=width,
        )
        assert u.select_lags(sweep).first().lag_hours == 7
        assert sweep.count() == 13


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([(s, i, 5.0) for s in ("up", "t") for i in range(300)], SERIES)
    links = spark.createDataFrame([("t", "up")], "target_id string, gauge_id string")
    sweep = u.lag_sweep(step_changes(df.where("series = 'up'")), step_changes(df.where("series = 't'")), links, 5, 10)
    assert [r.correlation for r in sweep.collect()] == [None] * 6
    assert u.select_lags(sweep).first().lag_hours is None


def ridge_data(spark, columns, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x_values = rng.normal(size=(n, columns)) * np.arange(1, columns + 1) + 10
    y = np.column_stack([x_values @ rng.normal(size=columns) + k for k in range(len(HORIZONS))])
    names = [f"f{i}" for i in range(columns)] + x.label_names()
    rows = [("t", *map(float, r)) for r in np.column_stack([x_values, y])]
    return x_values, y, spark.createDataFrame(rows, ["target_id", *names])


@pytest.mark.parametrize("columns", [1, 2, 6])
def test_ridge_solves_the_penalised_normal_equations(spark, columns):
    x_values, y, df = ridge_data(spark, columns)
    names = [f"f{i}" for i in range(columns)]
    got = m.fit_ridge(df, names).first()
    z = (x_values - x_values.mean(0)) / x_values.std(0)
    design = np.column_stack([np.ones(len(z)), z])
    penalty = np.eye(columns + 1) * 1e-3
    penalty[0, 0] = 0
    want = np.linalg.solve(design.T @ design + penalty, design.T @ y)
    assert np.allclose(got.intercept, want[0]) and np.allclose(np.array(got.weights), want[1:])
    scored = m.predict(df, m.fit_ridge(df, names), names).first()
    assert abs(scored.p_1 - scored.y_1) < 1e-2


def test_ridge_with_a_constant_column(spark):
    df = spark.createDataFrame(
        [("t", float(i), 4.0, *[3.0 + 2.0 * i] * 5) for i in range(50)],
        ["target_id", "a", "b", *x.label_names()],
    )
    got = m.fit_ridge(df, ["a", "b"]).first()
    assert got.feature_scales[1] == 1.0 and abs(got.weights[1][0]) < 1e-9
    assert np.isclose(got.weights[0][0] / got.feature_scales[0], 2.0, atol=1e-3)


def metric_rows(spark, model, values, high):
    return spark.createDataFrame([("x", model, *values, high)], "target_id string, model string, mae_1 double, mae_6 double, mae_24 double, high_stage_mae double")


@pytest.mark.parametrize(
    "values,high,allowed",
    [((0.98, 0.97, 0.96), 1.01, True), ((1.06, 0.8, 0.8), 0.8, False), ((0.99, 0.99, 0.99), 1.0, False), ((0.9, 0.9, 0.9), 1.06, False), ((0.9, 0.9, 0.9), float("inf"), False)],
)
def test_promotion_gate(spark, values, high, allowed):
    got = m.compare(metric_rows(spark, "c", (1.0, 1.0, 1.0), 1.0), metric_rows(spark, "x", values, high))
    assert got.first().promotion_allowed is allowed


def test_pinball_of_an_exact_prediction_is_zero(spark):
    df = spark.createDataFrame([("t", q, 5.0, 5.0) for q in (0.05, 0.5, 0.95)], "target_id string, quantile double, prediction double, actual double")
    assert m.pinball(df).first().pinball_loss == 0.0


def test_high_stage_error_is_infinite_without_high_rows(spark):
    names = [f"p_{h}" for h in HORIZONS] + [f"y_{h}" for h in HORIZONS]
    scored = spark.createDataFrame([("t", *[1.0] * 5, *[2.0] * 5)], ["target_id", *names])
    levels = spark.createDataFrame([("t", *[9.0] * 5)], ["target_id", *[f"t_{h}" for h in HORIZONS]])
    assert m.high_stage_mae(scored, levels).first().high_stage_mae == float("inf")
    low = levels.withColumn("t_6", F.lit(2.0))
    assert m.high_stage_mae(scored, low).first().high_stage_mae == 1.0


def test_score_steps(spark):
    row = spark.range(1).select(
        m.improves(F.lit(0.5), F.lit(None).cast("double")).alias("first"),
        m.improves(F.lit(0.5), F.lit(0.50005)).alias("same"),
        m.improves(F.lit(0.5), F.lit(0.51)).alias("better"),
    ).first()
    assert (row.first, row.same, row.better) == (True, False, True)
