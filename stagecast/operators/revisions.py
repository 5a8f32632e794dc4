"""Revisioned observations: canonical views, anti-joins, high-water marks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("source", "time_series_id", "event_time")
REVISION_KEY = (*IDENTITY, "payload_hash")
BY_TIME = ("gauge_id", "parameter_code", "event_time")


def _column(time: datetime | Column) -> Column:
    return time if isinstance(time, Column) else F.lit(time)


def scan(
    observations: DataFrame,
    gauges: Sequence[str] | None = None,
    parameter: str | None = None,
    source: str | None = None,
    start: datetime | Column | None = None,
    before: datetime | Column | None = None,
) -> DataFrame:
    """Filtered read; plain predicates, so partitions and row groups are pruned.

    Stored tables are partitioned by ``event_month``; bounds on the event time bound it as well.
    """
    df = observations
    if "event_month" in df.columns:
        if start is not None:
            df = df.where(F.col("event_month") >= F.date_format(_column(start), "yyyy-MM"))
        if before is not None:
            df = df.where(F.col("event_month") <= F.date_format(_column(before), "yyyy-MM"))
    if gauges is not None:
        df = df.where(F.col("gauge_id").isin(*gauges))
    if parameter is not None:
        df = df.where(F.col("parameter_code") == parameter)
    if source is not None:
        df = df.where(F.col("source") == source)
    if start is not None:
        df = df.where(F.col("event_time") >= start)
    if before is not None:
        df = df.where(F.col("event_time") < before)
    return df


def canonical(
    revisions: DataFrame, identity: Sequence[str] = IDENTITY, ignore_null_revisions: bool = False
) -> DataFrame:
    """Latest revision per identity; the payload hash settles ties.

    The newest revision wins even when it withdraws the value. ``ignore_null_revisions`` keeps an
    older value instead. The filter on the row number becomes a group limit below the shuffle, so
    a much-revised identity leaves each task as one row.
    """
    df = revisions.where(F.col("value").isNotNull()) if ignore_null_revisions else revisions
    newest = Window.partitionBy(*identity).orderBy(
        F.col("ingested_at").desc(), F.col("payload_hash").desc()
    )
    return (
        df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")
    )


def newest(revisions: DataFrame, limit: int, per: Sequence[str] = ("gauge_id",)) -> DataFrame:
    """The newest ``limit`` canonical observations per gauge (corrections do not use up the limit)."""
    latest = Window.partitionBy(*per).orderBy(
        F.col("event_time").desc(), F.col("time_series_id"), F.col("source")
    )
    return (
        canonical(revisions)
        .withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") <= limit)
        .drop("_rn")
    )


def new_revisions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct incoming revisions that are not stored yet."""
    return incoming.dropDuplicates(list(REVISION_KEY)).join(
        stored.select(*REVISION_KEY), list(REVISION_KEY), "left_anti"
    )


def known_revisions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct incoming revisions that are stored already."""
    return incoming.dropDuplicates(list(REVISION_KEY)).join(
        stored.select(*REVISION_KEY), list(REVISION_KEY), "left_semi"
    )


def revision_statistics(revisions: DataFrame, keys: Sequence[str] = ("gauge_id",)) -> DataFrame:
    """Rows, distinct (time, hash) pairs, repeated rows and times with more than one row."""
    by_hash = revisions.groupBy(*keys, "event_time", "payload_hash").agg(F.count("*").alias("n"))
    by_time = by_hash.groupBy(*keys, "event_time").agg(
        F.sum("n").alias("n"), F.count("*").alias("hashes")
    )
    return by_time.groupBy(*keys).agg(
        F.sum("n").alias("revision_rows"),
        F.count("*").alias("observation_times"),
        (F.sum("n") - F.sum("hashes")).alias("duplicate_revision_rows"),
        F.count_if(F.col("n") > 1).alias("observation_times_with_revisions"),
    )


def high_water(revisions: DataFrame) -> DataFrame:
    """Newest event time per series."""
    return revisions.groupBy("source", F.col("time_series_id").alias("series_key")).agg(
        F.max("event_time").alias("event_time")
    )


def advance_high_water(current: DataFrame, revisions: DataFrame) -> DataFrame:
    """High-water marks after a batch; a mark never moves back."""
    return (
        current.select("source", "series_key", "event_time")
        .unionByName(high_water(revisions))
        .groupBy("source", "series_key")
        .agg(F.max("event_time").alias("event_time"))
    )


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
