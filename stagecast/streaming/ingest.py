"""Ingestion of observation events, as a stream or directly.

Both ways end in ``store_batch``. Delivery is at least once: revisions lie in folders by
parameter, month and batch, marks and dead letters by batch; a replay overwrites the folders of
its own batch, and the anti-join looks at the other batches only. A batch lists and reads just the
months it holds itself, of compacted ones (see ``compaction``) the packed files and later batches. Late data and corrections are new revisions and kept; the canonical series
is a query over the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stagecast.operators.revisions import high_water, new_revisions
from stagecast.schemas import REVISION
from stagecast.sources.envelopes import TOPIC, accepted, checked, encode, refused
from stagecast.sources.tables import read_table, with_month
from stagecast.streaming.compaction import marks, month_parts, stored_parts

DEAD = "value string, reason string"


def kafka_values(spark: SparkSession, servers: str, topic: str = TOPIC, offsets: str = "latest") -> DataFrame:
    """Event values of a topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def file_values(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Event values, one per line, of files landing in a folder."""
    return (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path)
    )


def revisions_table(spark: SparkSession, root: str) -> DataFrame:
    """All revisions: compacted months and the batches since."""
    return stored_parts(spark, root, month_parts(spark, root))


def dead_letter_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/dead", DEAD)


def high_water_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest event time of each series; every batch stores the marks of its own revisions."""
    return marks(spark, root).groupBy("source", "series_key").agg(F.max("event_time").alias("event_time"))


def store_batch(revisions: DataFrame, batch_id: int, root: str) -> None:
    """Keep the revisions that are new and the marks of all of them.

    ``revisions`` is read several times. Files are laid out so that a read of a parameter, months
    and gauges prunes the rest; a month with most of the rows is spread by gauge and time.
    """
    spark = revisions.sparkSession
    revisions = with_month(revisions)
    held = revisions.select("parameter_code", "event_month").distinct().collect()  # a row per month
    months = [f"parameter_code={r.parameter_code}/event_month={r.event_month}" for r in held]
    stored = stored_parts(spark, root, months, skip=batch_id)
    spread = F.pmod(F.xxhash64("gauge_id", "event_time"), F.lit(64))
    (
        new_revisions(revisions, stored)
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .repartition("parameter_code", "event_month", spread)
        .sortWithinPartitions("parameter_code", "event_month", "gauge_id", "event_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("parameter_code", "event_month", "batch_id")
        .parquet(f"{root}/revisions")
    )
    high_water(revisions).write.mode("overwrite").parquet(f"{root}/high_water/batch_id={batch_id}")


def ingest_batch(events: DataFrame, batch_id: int, root: str) -> None:
    """Decode, keep what is new with its marks, set aside what breaks the contract."""
    parsed = checked(events).persist()  # several outputs from one parse; lost parts are parsed again
    store_batch(accepted(parsed), batch_id, root)
    refused(parsed).write.mode("overwrite").parquet(f"{root}/dead/batch_id={batch_id}")
    parsed.unpersist()


def ingest(
    observations: DataFrame, mode: str, root: str, landing: str | None = None, batch_id: int | None = None
) -> None:
    """The one configured path for live readings: straight into the table, or onto the stream.

    ``direct`` stores a batch of its own, by default the one after the last with marks.
    ``streaming`` leaves encoded events in the landing folder for ``file_values``; a broker takes
    the same rows with ``encode(...).write.format("kafka")``.
    """
    if mode == "direct":
        if batch_id is None:
            last = marks(observations.sparkSession, root).agg(F.max("batch_id").alias("b")).first().b
            batch_id = 0 if last is None else last + 1
        fields = observations.sparkSession.createDataFrame([], REVISION).schema
        store_batch(observations.select(*[F.col(f.name).cast(f.dataType) for f in fields]), batch_id, root)
    elif mode == "streaming":
        encode(observations).select("value").write.mode("append").text(landing)
    else:
        raise ValueError(f"unknown ingestion mode {mode}")


def start(
    values: DataFrame,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    sink: Callable[[DataFrame, int, str], None] = ingest_batch,
) -> StreamingQuery:
    """Run a sink over a stream of events; every five minutes unless told otherwise."""
    return (
        values.writeStream.foreachBatch(lambda df, batch_id: sink(df, batch_id, root))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 minutes"}))
        .start()
    )


def run_available(values: DataFrame, root: str, checkpoint: str, sink=ingest_batch) -> None:
    """Take in all that has landed, then stop."""
    query = start(values, root, checkpoint, {"availableNow": True}, sink)
    query.awaitTermination()
