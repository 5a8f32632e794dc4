from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stagecast.functions import columns as c


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "age,expected",
    [(90.0, "supported"), (91.0, "degraded"), (120.0, "degraded"), (121.0, "suppressed"), (-1.0, None)],
)
def test_freshness_bounds(spark, age, expected):
    assert one(spark, c.freshness(F.col("a")), a=age) == expected


def test_sentinels_are_null_and_zero_is_not(spark):
    rows = spark.createDataFrame([(-999999.0,), (-9999.0,), (-999.0,), (0.0,), (None,)], "v double")
    assert [r.x for r in rows.select(c.sentinel_to_null(F.col("v")).alias("x")).collect()] == [
        None, None, None, 0.0, None,
    ]


@pytest.mark.parametrize("text,value", [("1.5", 1.5), ("-2e3", -2000.0), ("1d", None), ("NaN", None), ("x", None)])
def test_only_plain_numbers_are_read(spark, text, value):
    assert one(spark, c.strict_double(F.col("t")), t=text) == value


def test_expected_samples_counts_both_ends(spark):
    month = F.lit(date(2007, 10, 1))
    got = c.expected_samples(month, F.lit(date(2007, 10, 15)), F.lit(date(2007, 10, 20)))
    assert one(spark, got) == 576


def test_month_count_is_inclusive():
    assert c.month_count(date(2024, 1, 1), date(2024, 12, 31)) == 12
    assert c.month_count(date(2024, 6, 1), date(2025, 6, 1)) == 13


@pytest.mark.parametrize(
    "day,expected",
    [
        (date(2017, 12, 31), "training"),
        (date(2018, 1, 1), "validation"),
        (date(2021, 1, 1), "calibration"),
        (date(2024, 1, 1), None),
    ],
)
def test_development_splits_leave_the_test_period_out(spark, day, expected):
    from stagecast.constants import SPLITS

    got = c.split_of(F.lit(day), date(2026, 9, 13), SPLITS[:3], open_start=True)
    assert one(spark, got) == expected


def test_training_has_no_lower_bound_when_open(spark):
    day = F.lit(date(1999, 1, 1))
    assert one(spark, c.split_of(day, date(2026, 1, 1), open_start=True)) == "training"
    assert one(spark, c.split_of(day, date(2026, 1, 1))) is None


def test_iso_text_shows_microseconds_only_when_there_are_some(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:00.5' b")
    got = rows.select(c.iso_utc(F.col("a")).alias("a"), c.iso_utc(F.col("b")).alias("b")).first()
    assert (got.a, got.b) == ("2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.500000+00:00")


def test_crossing_quantiles_are_found(spark):
    ordered = F.create_map(F.lit("0.05"), F.lit(1.0), F.lit("0.5"), F.lit(2.0), F.lit("0.1"), F.lit(1.5))
    crossed = F.create_map(F.lit("0.05"), F.lit(3.0), F.lit("0.5"), F.lit(2.0))
    assert one(spark, c.quantiles_ordered(ordered)) is True
    assert one(spark, c.quantiles_ordered(crossed)) is False


def test_two_digit_year_goes_back_a_century_when_far_ahead(spark):
    anchor = F.lit(datetime(2024, 6, 1)).cast("timestamp")
    assert one(spark, c.repair_two_digit_year(F.lit("241101"), anchor)) == date(2024, 11, 1)
    assert one(spark, c.repair_two_digit_year(F.lit("950101"), anchor)) == date(1995, 1, 1)


def test_daylight_saving_is_honoured(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-15 06:00:00' w, timestamp_ntz'2024-07-15 06:00:00' s")
    zone = c.zone_name(F.lit("C"))
    got = rows.select(
        c.local_to_utc(F.col("w"), zone).alias("w"), c.local_to_utc(F.col("s"), zone).alias("s")
    ).first()
    assert (got.w.hour, got.s.hour) == (12, 11)


def test_nested_crossing_label(spark):
    label = c.crossed(F.col("m"), F.col("n"), 4, F.lit(12.0))
    assert one(spark, label, m=12.1, n=1) is True
    assert one(spark, label, m=11.9, n=1) is None
    assert one(spark, label, m=11.9, n=4) is False
