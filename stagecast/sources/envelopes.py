"""Versioned observation events: encode, decode, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.schemas import ENVELOPE

VERSION, EVENT_TYPE, TOPIC = 1, "observation_revision", "observations"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}
_MOMENTS = ("event_time", "first_seen_at", "ingested_at", "source_modified_at")
_FIELDS = (
    "source", "time_series_id", "gauge_id", "parameter_code", "event_time", "value", "unit",
    "first_seen_at", "ingested_at", "source_modified_at", "qualifiers", "approved",
)


def encode(observations: DataFrame) -> DataFrame:
    """Key and JSON value of each revision, keyed by gauge; ready for a keyed sink.

    ``raw_payload`` (a map) is passed on when present.
    """
    raw = (
        F.col("raw_payload")
        if "raw_payload" in observations.columns
        else F.create_map().cast("map<string,string>")
    )
    fields = [
        F.col(name).cast("timestamp").alias(name) if name in _MOMENTS else F.col(name)
        for name in _FIELDS
    ]
    envelope = F.struct(
        F.lit(VERSION).alias("schema_version"),
        F.lit(EVENT_TYPE).alias("event_type"),
        F.struct(*fields, F.col("payload_hash").alias("raw_payload_hash")).alias("observation"),
        raw.alias("raw_payload"),
    )
    return observations.select(
        F.col("gauge_id").alias("key"),
        F.to_json(envelope, {"ignoreNullFields": "false", **_TIMES}).alias("value"),
    )


def checked(values: DataFrame) -> DataFrame:
    """Events parsed once: ``value``, the envelope ``e`` and ``reason`` where it breaks the contract.

    The generator keeps filters on the parsed fields above the parse; pushed below it, each field
    they name would be a parse of its own.
    """
    parsed = values.withColumn("e", F.explode(F.array(F.from_json("value", ENVELOPE))))
    o = "e.observation."
    required = ("source", "time_series_id", "gauge_id", "parameter_code", "event_time", "unit",
                "first_seen_at", "ingested_at", "raw_payload_hash")
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(o + name).isNotNull()
    known = (F.col("e.schema_version") == VERSION) & (F.col("e.event_type") == EVENT_TYPE)
    reason = (
        F.when(~F.coalesce(known, F.lit(False)), "unsupported observation event")
        .when(F.col("e.raw_payload").isNull(), "no raw payload object")
        .when(~whole, "incomplete observation")
    )
    return parsed.withColumn("reason", reason)


def decode(values: DataFrame) -> DataFrame:
    """Revisions of the events that meet the contract."""
    return accepted(checked(values))


def dead_letters(values: DataFrame) -> DataFrame:
    """Events that do not, with the reason."""
    return refused(checked(values))


def accepted(events: DataFrame) -> DataFrame:
    o = "e.observation."
    return events.where(F.col("reason").isNull()).select(
        *[F.col(o + name).alias(name) for name in _FIELDS if name != "qualifiers" and name != "approved"],
        F.coalesce(o + "qualifiers", F.array().cast("array<string>")).alias("qualifiers"),
        F.col(o + "approved").alias("approved"),
        F.col(o + "raw_payload_hash").alias("payload_hash"),
        F.col("e.raw_payload").alias("raw_payload"),
    )


def refused(events: DataFrame) -> DataFrame:
    return events.where(F.col("reason").isNotNull()).select("value", "reason")
