"""Regular series: ``series``, ``idx`` (whole steps since the epoch), ``value``.

A missing step is an absent row. The step is an hour for gauges; any other works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.constants import HOUR, MINUTE
from stagecast.functions.columns import log1p_clamped, micros, step_index
from stagecast.operators.blocks import before_block, block_start, in_block, with_blocks
from stagecast.operators.quantiles import quantile_columns


def step_means(readings: DataFrame, series: str = "gauge_id", step: int = HOUR) -> DataFrame:
    """Mean value per series and step, nulls left out."""
    return (
        readings.where(F.col("value").isNotNull())
        .groupBy(F.col(series).alias("series"), step_index(micros(F.col("event_time")), step).alias("idx"))
        .agg(F.avg("value").alias("value"))
    )


def step_changes(series: DataFrame, log: bool = False, width: int = 1024) -> DataFrame:
    """Change from exactly one step earlier; no row where that step is absent."""
    w = in_block(["series"], "idx")
    level = log1p_clamped(F.col("value")) if log else F.col("value")
    return (
        with_blocks(series, "idx", width, before=1)
        .withColumn("level", level)
        .withColumn("prior_idx", F.lag("idx").over(w))
        .withColumn("prior", F.lag("level").over(w))
        .where(F.col("home") & (F.col("prior_idx") == F.col("idx") - 1))
        .select("series", "idx", (F.col("level") - F.col("prior")).alias("change"))
    )


def densify(series: DataFrame, width: int = 1024) -> DataFrame:
    """Every step from first to last, null where nothing was seen.

    The spine is laid out block by block, so no task holds a whole series' steps.
    """
    spans = series.groupBy("series").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    w = F.lit(width).cast("bigint")
    blocks = spans.withColumn(
        "block",
        F.explode(F.sequence(block_start(F.col("first"), width), block_start(F.col("last"), width), w)),
    ).repartition("series", "block")
    spine = blocks.select(
        "series",
        F.explode(
            F.sequence(
                F.greatest("first", "block"), F.least("last", F.col("block") + w - 1)
            )
        ).alias("idx"),
    )
    return spine.join(series, ["series", "idx"], "left")


def quarter_hour_coverage(
    readings: DataFrame, expected: int, keys: Sequence[str] = ("gauge_id",), step: int = 15 * MINUTE
) -> DataFrame:
    """Populated quarter hours over those expected; readings at a finer rate count once."""
    bins = (
        readings.where(F.col("value").isNotNull())
        .select(*keys, step_index(micros(F.col("event_time")), step).alias("bin"))
        .distinct()
    )
    return bins.groupBy(*keys).agg(
        F.count("*").alias("populated_bins"), (F.count("*") / F.lit(expected)).alias("coverage")
    )


def gap_summary(
    samples: DataFrame, keys: Sequence[str] = ("gauge_id",), width: int = 30 * 24 * HOUR
) -> DataFrame:
    """Steps over 30 minutes, 6 and 24 hours, and the longest in hours, per key.

    Gaps inside a block are folded there; the step from one block to the next comes from the
    per-block first and last times.
    """
    keys = list(keys)
    rows = with_blocks(
        samples.select(*keys, micros(F.col("event_time")).alias("us")), "us", width
    )
    gap = F.col("gap")
    counts = [
        F.count_if(gap > limit).alias(name)
        for name, limit in (("n30", 30 * MINUTE), ("n6", 6 * HOUR), ("n24", 24 * HOUR))
    ]
    folded = (
        rows.withColumn("gap", F.col("us") - F.lag("us").over(in_block(keys, "us")))
        .groupBy(*keys, "block")
        .agg(
            *counts,
            F.max(F.when(gap > 30 * MINUTE, gap)).alias("longest"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
    )
    edge = F.col("first_us") - F.col("last_us")  # last_us is that of the blocks before
    edges = before_block(folded, keys, maxima=["last_us"])

    def total(name: str, limit: int):
        return (F.sum(name) + F.count_if(edge > limit)).cast("bigint")

    longest = F.greatest(F.max("longest"), F.max(F.when(edge > 30 * MINUTE, edge)))
    return edges.groupBy(*keys).agg(
        total("n30", 30 * MINUTE).alias("over_30_minutes"),
        total("n6", 6 * HOUR).alias("over_6_hours"),
        total("n24", 24 * HOUR).alias("over_24_hours"),
        F.coalesce(longest / F.lit(float(HOUR)), F.lit(0.0)).alias("longest_hours"),
    )


def value_summary(samples: DataFrame, keys: Sequence[str] = ("gauge_id",)) -> DataFrame:
    """Valid and null samples, minimum, exact median and maximum."""
    basic = samples.groupBy(*keys).agg(
        F.count("value").alias("valid_samples"),
        F.count_if(F.col("value").isNull()).alias("null_samples"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    middle = quantile_columns(samples, keys, "value", {"median": 0.5})
    return basic.join(middle, list(keys), "left")
