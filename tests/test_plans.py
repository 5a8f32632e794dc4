"""Feature sets from a manifest, and what training refuses."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stagecast.constants import HOUR
from stagecast.plans.features import MissingExamples, build_feature_set
from stagecast.plans.training import EmptySplit, require_splits, split_counts
from stagecast.sources.tables import FrozenInputChanged, manifest

CUTOFF = date(1970, 1, 9)


def series(spark, names=("a", "b", "c"), steps=240):
    return spark.range(steps).selectExpr("id as idx", "explode(array(%s)) as series" % ", ".join(f"'{n}'" for n in names)).selectExpr(
        "series", "idx", "double(idx + 100 * ascii(series)) as value"
    )


def day():
    return F.timestamp_micros(F.col("idx") * HOUR).cast("date")


def build(spark, path, rows, lags, cutoff=CUTOFF, frozen=None, inputs=None):
    report = spark.createDataFrame(lags, "target_id string, gauge_id string, lag_hours int, suitable boolean")
    known = frozen or manifest(report, {"series": rows}, CUTOFF)
    return build_feature_set(known, {"series": rows} if inputs is None else inputs, rows, rows, day(), cutoff, str(path))


LAGS = [("a", "c", 2, True), ("a", "b", 5, True), ("b", "c", 1, True), ("c", "a", 1, False)]


def test_examples_of_every_target(spark, tmp_path):
    rows = series(spark)
    found = build(spark, tmp_path / "set", rows, LAGS)
    assert (tmp_path / "set" / "target_id=a").exists()
    got = {(r.target_id, r.idx): r for r in found.collect()}
    one = got["a", 50]
    assert one.upstream == [100.0 * ord("b") + 45, 100.0 * ord("c") + 48] and one.upstream_gauges == ["b@5", "c@2"]
    assert got["c", 50].upstream == [] and got["b", 50].upstream_gauges == ["c@1"]
    assert max(idx for _, idx in got) == 240 - 72 - 1


def test_refusals(spark, tmp_path):
    rows = series(spark)
    with pytest.raises(FrozenInputChanged):
        build(spark, tmp_path / "1", rows, LAGS, cutoff=date(1970, 1, 8))
    with pytest.raises(FrozenInputChanged):
        build(spark, tmp_path / "2", rows, LAGS, inputs={"series": rows.where("idx <> 7")})
    with pytest.raises(MissingExamples, match="no examples of z"):
        build(spark, tmp_path / "3", rows, [*LAGS, ("z", "a", 1, True)])


def test_empty_splits_are_refused(spark):
    rows = spark.createDataFrame(
        [("a", "training"), ("a", "validation"), ("a", "calibration"), ("b", "training"), ("b", "validation")], "target_id string, split string"
    )
    with pytest.raises(EmptySplit, match="for b"):
        require_splits(split_counts(rows))
    require_splits(split_counts(rows.where("target_id = 'a'")))
