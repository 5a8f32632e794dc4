"""Coverage by month and season, expected partitions and completeness gates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.functions.columns import expected_samples, season


class IncompleteArchiveError(RuntimeError):
    pass


def months_between(start: date, end: date) -> Column:
    """Array of month starts from the month of ``start`` to that of ``end``."""
    return F.sequence(
        F.trunc(F.lit(start), "MM"), F.lit(end), F.expr("interval 1 month")
    )


def month_windows(df: DataFrame, start: date, end: date) -> DataFrame:
    """Add half-open monthly ranges clipped to the given days: ``begin`` and ``finish``."""
    return (
        df.withColumn("month", F.explode(months_between(start, end)))
        .withColumn("begin", F.greatest("month", F.lit(start)))
        .withColumn(
            "finish", F.least(F.add_months("month", 1), F.date_add(F.lit(end), 1))
        )
    )


def monthly_coverage(
    samples: DataFrame,
    gauges: DataFrame,
    start: date,
    end: date,
    keys: Sequence[str] = ("gauge_id",),
    per_day: int = 96,
) -> DataFrame:
    """Non-null samples against those due, for every gauge and month, empty months included."""
    observed = (
        samples.where(F.col("value").isNotNull())
        .groupBy(*keys, F.trunc(F.col("event_time").cast("date"), "MM").alias("month"))
        .agg(F.count("*").alias("observed"))
    )
    due = expected_samples(F.col("month"), F.lit(start), F.lit(end), per_day)
    spine = gauges.select(*keys).distinct().withColumn("month", F.explode(months_between(start, end)))
    return (
        spine.join(observed, [*keys, "month"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .withColumn("expected", due)
        .withColumn("coverage", F.try_divide(F.col("observed"), F.col("expected")))
    )


def seasonal_coverage(monthly: DataFrame, keys: Sequence[str] = ("gauge_id",)) -> DataFrame:
    """Plain mean of the monthly coverages by season."""
    return monthly.groupBy(*keys, season(F.month("month")).alias("season")).agg(
        F.avg("coverage").alias("mean_coverage")
    )


def low_months(monthly: DataFrame, minimum: float = 0.9) -> DataFrame:
    return monthly.where(F.col("coverage") < minimum)


def overall_coverage(
    samples: DataFrame,
    start: date,
    end: date,
    keys: Sequence[str] = ("gauge_id",),
    per_day: int = 96,
    minimum: float = 0.9,
) -> DataFrame:
    """Samples, span and share of those due between two days."""
    due = max(0, (end - start).days + 1) * per_day
    return (
        samples.groupBy(*keys)
        .agg(
            F.count("*").alias("samples"),
            F.min("event_time").alias("first_observation"),
            F.max("event_time").alias("last_observation"),
        )
        .withColumn("expected_samples", F.lit(due).cast("bigint"))
        .withColumn("coverage_fraction", F.col("samples") / F.lit(due) if due else F.lit(0.0))
        .withColumn("complete", F.col("coverage_fraction") >= minimum)
    )


def expected_partitions(gauges: DataFrame, parameters: Sequence[str], start: date, end: date) -> DataFrame:
    """One row per gauge, parameter and month, with its resource name."""
    spine = month_windows(
        gauges.select("gauge_id")
        .distinct()
        .withColumn("parameter_code", F.explode(F.array(*map(F.lit, parameters)))),
        start,
        end,
    )
    return spine.withColumn("resource", resource_name())


def resource_name() -> Column:
    return F.concat_ws(
        "/",
        F.lit("continuous"),
        F.col("gauge_id"),
        F.col("parameter_code"),
        F.date_format("month", "yyyy-MM"),
    )


def missing_partitions(expected: DataFrame, catalogue: DataFrame, source: str = "usgs") -> DataFrame:
    """Expected partitions with no archived payload."""
    done = catalogue.where(F.col("source") == source).select("resource")
    return expected.join(done, "resource", "left_anti")


def archived_partitions(catalogue: DataFrame, source: str = "usgs") -> DataFrame:
    """Distinct archived months per gauge and parameter."""
    parts = F.split("resource", "/")
    return (
        catalogue.where((F.col("source") == source) & F.col("resource").startswith("continuous/"))
        .select(parts[1].alias("gauge_id"), parts[2].alias("parameter_code"), "resource")
        .distinct()
        .groupBy("gauge_id", "parameter_code")
        .agg(F.count("*").alias("complete"))
    )


def incomplete_series(required: DataFrame, archived: DataFrame, required_months: int) -> DataFrame:
    """Gauges with fewer archived months than required."""
    return (
        required.join(archived, ["gauge_id", "parameter_code"], "left")
        .withColumn("complete", F.coalesce("complete", F.lit(0)))
        .withColumn("required", F.lit(required_months).cast("bigint"))
        .where(F.col("complete") < F.col("required"))
        .select("gauge_id", "parameter_code", "complete", "required")
    )


def require_complete(incomplete: DataFrame, shown: int = 20) -> None:
    """Refuse partial data; the message names the first few gauges."""
    first = incomplete.orderBy("gauge_id", "parameter_code").limit(shown).collect()
    if first:
        raise IncompleteArchiveError(
            "partial data refused: "
            + ", ".join(f"{r.gauge_id}/{r.parameter_code} {r.complete} of {r.required}" for r in first)
        )
