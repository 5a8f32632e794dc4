"""Live views with bounded state: windows and trigger sessions behind a watermark.

The watermark bounds the state of these views only; revisions go through ``ingest``, which keeps
late ones. A window or session is given out once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELAY = "2 hours"
READING = "gauge_id string, at timestamp, value double"
TRIGGER = "target_id string, at timestamp, kind string"


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files landing in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count, mean and maximum of the valid readings of each gauge and window; batch or stream."""
    return (
        rows.where(F.col("value").isNotNull())
        .groupBy("gauge_id", F.window("at", width).alias("w"))
        .agg(F.count("value").alias("readings"), F.avg("value").alias("mean"), F.max("value").alias("most"))
        .select("gauge_id", F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "readings", "mean", "most")
    )


def live_windows(stream: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """``windowed`` over a stream; windows behind the watermark leave the state."""
    return windowed(stream.withWatermark("at", delay), width)


def live_sessions(stream: DataFrame, gap: str = "5 minutes", delay: str = DELAY) -> DataFrame:
    """Triggers ``(target_id, at, kind)`` at most ``gap`` apart as one row, once no more can join it."""
    return (
        stream.withWatermark("at", delay)
        .groupBy("target_id", F.session_window("at", gap).alias("w"))
        .agg(
            F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("triggers"),
            F.array_sort(F.collect_set("kind")).alias("kinds"),
        )
        .select("target_id", "first_at", "last_at", "triggers", "kinds")
    )


def run_view(view: DataFrame, path: str, checkpoint: str) -> None:
    """Work off all that has landed and append the finished rows to a table.

    The file sink names the files of each batch in its log, so a batch that is run again after a
    failure does not double its rows.
    """
    view.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


def late_rows(rows: DataFrame, delay: str = DELAY, width: str = "1 hour") -> DataFrame:
    """Rows ``(batch_id, at, ...)`` that came after the watermark had passed their window.

    The watermark of a batch is the newest time of the batches before it, less the delay. A stream
    that goes on without a pause judges lateness by the mark one batch older, so it may still take
    some of these rows; after a run that has come to its end it takes none. The marks are a row
    per batch; only they are put in order.
    """
    marks = rows.groupBy("batch_id").agg(F.max("at").alias("newest"))
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("batch_id", (F.max("newest").over(before) - F.expr(f"interval {delay}")).alias("mark"))
    ends = F.window("at", width)["end"]
    return rows.withColumn("window_ends", ends).join(marks, "batch_id").where("window_ends <= mark").drop("window_ends", "mark")
