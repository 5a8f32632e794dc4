"""Labelled synthetic readings for tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.constants import STAGE
from stagecast.functions.columns import content_hash, iso_utc


def demo_observations(gauges: DataFrame, now: datetime, steps: int = 49) -> DataFrame:
    """Fifteen-minute readings up to ``now`` for gauges ``(gauge_id, position)``."""
    at = F.lit(now).cast("timestamp") - F.make_dt_interval(
        mins=(F.lit(steps - 1) - F.col("step")) * 15
    )
    rows = gauges.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "event_time", at
    )
    seen = F.col("event_time") + F.expr("interval 10 minutes")
    return rows.select(
        F.lit("demo").alias("source"),
        F.concat(F.lit("demo-"), "gauge_id", F.lit(f"-{STAGE}")).alias("time_series_id"),
        "gauge_id",
        F.lit(STAGE).alias("parameter_code"),
        "event_time",
        (F.lit(4.0) + F.col("position") * 1.7 + F.col("step") * 0.015).alias("value"),
        F.lit("ft").alias("unit"),
        seen.alias("first_seen_at"),
        seen.alias("ingested_at"),
        F.lit(None).cast("timestamp").alias("source_modified_at"),
        F.array(F.lit("synthetic-demo")).alias("qualifiers"),
        F.lit(False).alias("approved"),
        content_hash(F.concat_ws(":", F.lit("demo"), "gauge_id", iso_utc(F.col("event_time")))).alias("payload_hash"),
    )
