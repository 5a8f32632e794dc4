"""Landed source payloads as rows: readings, station snapshots, the payload catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.constants import STAGE
from stagecast.functions.columns import (
    blank_to_null,
    content_hash,
    sentinel_to_null,
    strict_double,
)
from stagecast.operators.revisions import latest_by
from stagecast.schemas import FEATURE_PROPERTIES, SNAPSHOT_METADATA


def _features(payloads: DataFrame) -> DataFrame:
    features = F.from_json("payload", "features array<string>")["features"]
    parsed = F.from_json("feature", f"properties struct<{_fields(FEATURE_PROPERTIES)}>")
    time = F.coalesce(
        *[blank_to_null(F.col(f"p.{name}")) for name in ("time", "datetime", "phenomenonTime")]
    )
    return (
        payloads.select("gauge_id", "parameter_code", "ingested_at", F.explode(features).alias("feature"))
        .withColumn("p", F.explode(F.array(parsed["properties"])))  # a generator, so that each feature is parsed once
        .withColumn("time_text", time)
        .withColumn("event_time", F.col("time_text").try_cast("timestamp"))
        .withColumn("number", strict_double(F.col("p.value")))
    )


def _fields(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


def payload_observations(payloads: DataFrame, source: str = "usgs") -> DataFrame:
    """Readings of continuous-values payloads ``(gauge_id, parameter_code, ingested_at, payload)``.

    Features without a time, and those whose value is no number, are left out (``payload_errors``
    has the latter): an unreadable value must not withdraw an earlier reading. Sentinels and
    values that are not given become null; ids and units fall back as the source leaves them out.
    """
    readable = F.col("p.value").isNull() | F.col("number").isNotNull()
    rows = _features(payloads).where(F.col("event_time").isNotNull() & readable)
    unit = F.when(F.col("parameter_code") == STAGE, "ft").otherwise("ft3/s")
    return rows.select(
        F.lit(source).alias("source"),
        F.coalesce(
            blank_to_null(F.col("p.time_series_id")),
            blank_to_null(F.col("p.monitoring_location_id")),
            F.col("gauge_id"),
        ).alias("time_series_id"),
        "gauge_id",
        "parameter_code",
        "event_time",
        sentinel_to_null(F.col("number")).alias("value"),
        F.coalesce(blank_to_null(F.col("p.unit_of_measure")), unit).alias("unit"),
        F.col("ingested_at").alias("first_seen_at"),
        "ingested_at",
        F.col("p.last_modified").try_cast("timestamp").alias("source_modified_at"),
        F.coalesce("p.qualifier", F.array().cast("array<string>")).alias("qualifiers"),
        F.coalesce(F.col("p.approval_status") == "Approved", F.lit(False)).alias("approved"),
        content_hash(F.col("feature")).alias("payload_hash"),
    )


def payload_errors(payloads: DataFrame) -> DataFrame:
    """Features whose time or value cannot be read."""
    bad_time = F.col("time_text").isNotNull() & F.col("event_time").isNull()
    bad_value = F.col("p.value").isNotNull() & F.col("number").isNull()
    return _features(payloads).where(bad_time | bad_value).select(
        "gauge_id",
        "parameter_code",
        "feature",
        F.when(bad_time, "unreadable time").otherwise("unreadable value").alias("reason"),
    )


def catalogue_entries(payloads: DataFrame) -> DataFrame:
    """Catalogue rows of payloads ``(source, resource, retrieved_at, payload)``, one per content.

    The earliest retrieval of a content is kept.
    """
    rows = payloads.select(
        content_hash(F.col("payload")).alias("content_hash"),
        "source",
        "resource",
        "retrieved_at",
        F.octet_length("payload").cast("bigint").alias("byte_count"),
    )
    return latest_by(rows, ["content_hash"], F.col("retrieved_at"), F.col("resource")).withColumn(
        "relative_path",
        F.concat_ws(
            "/",
            F.lit("raw"),
            "source",
            F.date_format("retrieved_at", "yyyy/MM/dd"),
            F.concat("content_hash", F.lit(".gz")),
        ),
    )


def new_entries(entries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows whose content is not archived yet."""
    return entries.join(catalogue.select("content_hash"), "content_hash", "left_anti")


def station_snapshots(metadata: DataFrame) -> DataFrame:
    """Snapshots of ``(gauge_id, nwps_id, captured_at, metadata)``: hash, thresholds, datum."""
    parsed = F.from_json("metadata", SNAPSHOT_METADATA)
    return metadata.withColumn("m", F.explode(F.array(parsed))).select(
        "gauge_id",
        "nwps_id",
        "captured_at",
        content_hash(F.col("metadata")).alias("content_hash"),
        F.coalesce("m.flood.categories", F.create_map().cast("map<string,string>")).alias("thresholds"),
        F.coalesce("m.datums.vertical.value", F.array().cast("array<string>")).alias("datum"),
    )


def changed_snapshots(snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots whose content is new, one per content."""
    return latest_by(snapshots, ["content_hash"], F.col("captured_at"), F.col("gauge_id")).join(
        stored.select("content_hash"), "content_hash", "left_anti"
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return latest_by(snapshots, ["gauge_id"], F.col("captured_at").desc(), F.col("content_hash"))


def threshold_rows(snapshots: DataFrame) -> DataFrame:
    """Official stage thresholds by name; entries that are no object or hold no stage are left out."""
    return (
        snapshots.select("gauge_id", F.explode("thresholds").alias("threshold_name", "details"))
        .withColumn("threshold", F.from_json("details", "stage double")["stage"])
        .where(F.col("threshold").isNotNull() & (F.col("threshold") != -9999))
        .select("gauge_id", "threshold_name", "threshold")
    )
