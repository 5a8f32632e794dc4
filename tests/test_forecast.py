from datetime import datetime, timedelta

import pytest
from demo import demo_observations
from pyspark.sql import functions as F

from stagecast.constants import DAY, DISCHARGE, HORIZONS, HOUR, QUANTILES
from stagecast.operators import forecast as f
from stagecast.operators import views
from stagecast.plans.shadow import challenger_inputs, shadow_cycle
from stagecast.sources.basins import basins
from stagecast.sources.tables import merge_forecasts

GAUGE = "05464500"
ISSUED = datetime(2026, 1, 1, 12, 30)


def state(spark, readings, issued=ISSUED, width=10 * DAY):
    rows = spark.createDataFrame(
        [(GAUGE, at, v, str(at)) for at, v in readings],
        "gauge_id string, event_time timestamp_ntz, value double, payload_hash string",
    )
    issues = spark.createDataFrame([(GAUGE, issued)], "gauge_id string, issued_at timestamp_ntz")
    return f.issue_state(rows, issues, width)


def limits(spark):
    return basins(spark).select(F.col("gauge_id").alias("target_id"), "flood_stage_ft")


def before(minutes):
    return ISSUED - timedelta(minutes=minutes)


def test_horizons_count_from_the_issue(spark):
    got = f.persistence_forecasts(state(spark, [(before(15), 5.0)]), limits(spark)).first()
    assert [p.horizon_hours for p in got.stage] == list(HORIZONS)
    assert got.stage[0].valid_at == ISSUED + timedelta(hours=1)
    assert got.horizon_model_mapping[72] == "no-nwp" and len(got.threshold_crossings) == 5
    assert got.stage[0].quantiles["0.5"] == 5.0 and len(got.discharge) == 5


@pytest.mark.parametrize("minutes,expected", [(90, "supported"), (91, "degraded"), (120, "degraded"), (121, None)])
def test_age_decides_whether_a_forecast_is_issued(spark, minutes, expected):
    known = state(spark, [(before(minutes), 5.0)])
    got = f.persistence_forecasts(known, limits(spark)).collect()
    assert [r.freshness for r in got] == ([expected] if expected else [])
    refused = f.refusals(known).collect()
    assert [r.reason for r in refused] == ([] if expected else ["too old"])


def test_stale_gauges_keep_their_age_across_blocks(spark):
    got = state(spark, [(before(60 * 24 * 40), 5.0)], width=DAY).first()
    assert got.observation_age_minutes == 60 * 24 * 40 and got.freshness == "suppressed"


def test_answers_do_not_depend_on_the_blocks(spark):
    for newest, prior in ((10, 68), (10, 100), (200, 260), (60 * 5, 60 * 6), (60 * 9, 60 * 10 + 5), (60 * 24 * 3, 60 * 25 * 3)):
        readings = [(before(prior), 4.0), (before(newest), 5.0), (before(prior + 60 * 24 * 20), 1.0)]
        got = {
            tuple(state(spark, readings, width=w).select("observed_value", "prior_value", "recent_count", "recent_first").first())
            for w in (HOUR, DAY, 7 * DAY, 10 * DAY, 400 * DAY)
        }
        assert len(got) == 1


def test_readings_after_the_issue_are_not_seen(spark):
    got = state(spark, [(before(10), 5.0), (ISSUED + timedelta(minutes=1), 9.0)], width=6 * HOUR).first()
    assert got.observed_value == 5.0


@pytest.mark.parametrize(
    "offsets,expected",
    [((45, 75), 75.0), ((50, 60, 70), 60.0), ((76,), None), ((44,), None), ((55, 66), 55.0), ((46,), 46.0), ((55, 65), 65.0)],
)
def test_prior_reading_is_the_one_nearest_an_hour_back(spark, offsets, expected):
    readings = [(before(0), 1.0)] + [(before(m), float(m)) for m in offsets]
    assert state(spark, readings).first().prior_value == expected


def model(spark):
    offsets = dict(zip(map(str, QUANTILES), (-1.0, -0.8, -0.5, 0.0, 0.5, 0.8, 1.0)))
    return spark.createDataFrame(
        [(GAUGE, [5.0, 0.0], [1.0, 1.0], [5.0] * 5, [[1.0] * 5, [0.0] * 5], {q: [v] * 5 for q, v in offsets.items()})],
        """target_id string, feature_means array<double>, feature_scales array<double>, intercept array<double>,
        weights array<array<double>>, residual_quantile_offsets map<string,array<double>>""",
    )


def test_ridge_serves_calibrated_stage_and_no_discharge(spark):
    known = state(spark, [(before(60), 4.0), (before(0), 5.0)])
    got = f.ridge_forecasts(known, model(spark), limits(spark)).first()
    assert got.stage[0].quantiles["0.5"] == 5.0 and got.discharge == []
    assert got.stage_model_version == f"direct-ridge-stage-v1-{GAUGE}"
    assert got.maximum_stage[4].quantiles["0.05"] == 5.0  # never below the latest value
    assert got.maximum_stage[4].quantiles["0.95"] == 6.0


def test_ridge_needs_the_reading_an_hour_back(spark):
    known = state(spark, [(before(0), 5.0)])
    assert f.ridge_forecasts(known, model(spark), limits(spark)).count() == 0
    assert f.refusals(known, needs_prior=True).first().reason == "no earlier reading"


@pytest.mark.parametrize("part", f.PARTS)
def test_a_crossing_in_any_part_rejects(spark, part):
    issued = f.persistence_forecasts(state(spark, [(before(0), 15.0), (before(60), 14.0)]), limits(spark))
    turned = F.transform(part, lambda p: p.withField("quantiles", F.transform_values(p["quantiles"], lambda _, v: -v)))
    both = issued.unionByName(issued.withColumn("target_id", F.lit("crossing")).withColumn(part, turned))
    assert [r.target_id for r in f.crossing_quantiles(both).collect()] == ["crossing"]
    assert f.ordered_only(both).count() == 1
    nothing = issued.withColumn(part, F.lit(None).cast(issued.schema[part].dataType))
    assert f.ordered_only(nothing).count() == 1 and f.crossing_quantiles(nothing).count() == 0


def test_quantiles_never_cross_and_ids_are_stable(spark):
    known = state(spark, [(before(0), 0.05), (before(60), 1.0)])
    issued = f.persistence_forecasts(known, limits(spark))
    assert f.ordered_only(issued).count() == 1 and f.crossing_quantiles(issued).count() == 0
    again = f.persistence_forecasts(known, limits(spark))
    assert issued.first().id == again.first().id
    assert merge_forecasts(issued, again).count() == 1
    assert views.forecast_by_id(issued, issued.first().id).count() == 1


def test_shadow_cycle_over_demo_readings(spark):
    gauges = basins(spark).select("gauge_id").withColumn("position", F.lit(0))
    rows = demo_observations(gauges, ISSUED)
    cycle = shadow_cycle(rows, model(spark), limits(spark), None, ISSUED)
    assert [r.target_id for r in cycle["summary"].collect()] == [GAUGE]
    assert rows.count() == 3 * 49 and cycle["refused"].count() == 0
    stored = shadow_cycle(rows, model(spark), limits(spark), cycle["forecasts"], ISSUED)
    assert stored["forecasts"].count() == 1


def test_discharge_and_other_times_change_nothing(spark):
    gauges = basins(spark).select("gauge_id").withColumn("position", F.lit(0))
    rows = demo_observations(gauges, ISSUED, steps=49)
    flows = rows.withColumn("parameter_code", F.lit(DISCHARGE)).withColumn("value", F.lit(950.0))
    later = rows.withColumn("event_time", F.col("event_time") + F.expr("interval 2 days")).withColumn("value", F.lit(77.0))
    targets = gauges.select(F.col("gauge_id").alias("target_id"))
    for more in (flows, later):
        both = rows.unionByName(more)
        one, two = (shadow_cycle(r, model(spark), limits(spark), None, ISSUED)["forecasts"] for r in (rows, both))
        assert one.select("id", "stage").collect() == two.select("id", "stage").collect()
        one, two = (challenger_inputs(r, targets, ISSUED, lookback=12)["histories"] for r in (rows, both))
        assert one.count() == 3 and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
