"""Event state over a stream of stage readings.

State per gauge is whether an event is open and the distinct batches below since the last
crossing, at most three ids. Each micro-batch replays that state as a few leading readings in
front of its own and runs the batch form, so a gauge with most of a batch's rows is spread over
blocks like any other; a keyed state function would take it in one task.

A reading that is not newer than its gauge's last one comes too late for that: it is set aside,
and ``corrected`` works the transitions of such gauges out again from all their readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.operators.events import event_state, event_transitions, transitions_and_state
from stagecast.sources.tables import read_table

READING = """
    gauge_id string, seq bigint, at timestamp, batch_id string, stage double, threshold double,
    stale boolean
"""
STATE = "gauge_id string, open boolean, below_batches array<string>, last_seq bigint"
TRANSITIONS = "gauge_id string, seq bigint, at timestamp, transition string"


def reading_values(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Readings as JSON lines landing in a folder."""
    return (
        spark.readStream.schema(READING).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def state_table(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The state after a batch; none before the first, and an error where a later one is gone."""
    return read_table(spark, f"{root}/state/batch_id={batch_id}", STATE, required=batch_id >= 0)


def late_table(spark: SparkSession, root: str) -> DataFrame:
    """Readings that came after newer ones of their gauge."""
    return read_table(spark, f"{root}/late", READING + ", late_in bigint")


def transition_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/transitions", TRANSITIONS + ", batch_id bigint")


def _replayed(state: DataFrame) -> DataFrame:
    """Readings that lead to a stored state: a crossing if open, then the batches below.

    They are numbered up to the gauge's last ``seq``, so they stand before all that is newer.
    """
    crossing = F.when(F.col("open"), F.array(F.lit(None).cast("string"))).otherwise(
        F.array().cast("array<string>")
    )
    steps = state.withColumn("steps", F.concat(crossing, "below_batches")).select(
        "gauge_id", "last_seq", F.size("steps").alias("n"), F.posexplode("steps").alias("i", "batch_id")
    )
    is_crossing = F.col("batch_id").isNull()
    return steps.select(
        "gauge_id",
        (F.col("last_seq") - F.col("n") + F.col("i") + 1).alias("seq"),
        F.lit(None).cast("timestamp").alias("at"),
        "batch_id",
        F.when(is_crossing, 1.0).otherwise(0.0).alias("stage"),
        F.lit(1.0).alias("threshold"),
        F.lit(False).alias("stale"),
    )


def observe_batch(readings: DataFrame, batch_id: int, root: str) -> None:
    """Transitions and new state of one micro-batch; late readings are set aside."""
    spark = readings.sparkSession
    state = state_table(spark, root, batch_id - 1)
    last = state.select("gauge_id", "last_seq")
    placed = readings.join(last, "gauge_id", "left").persist()  # read once for all outputs
    is_late = F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
    timely = placed.where(~is_late).drop("last_seq")
    placed.where(is_late).drop("last_seq").write.mode("overwrite").parquet(f"{root}/late/late_in={batch_id}")
    transitions, after, below = transitions_and_state(_replayed(state).unionByName(timely))
    below.persist()  # for both outputs
    (
        transitions
        .join(last, "gauge_id", "left")
        .where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")))
        .drop("last_seq")
        .write.mode("overwrite")
        .parquet(f"{root}/transitions/batch_id={batch_id}")
    )
    newest = timely.where(~F.col("stale")).groupBy("gauge_id").agg(F.max("seq").alias("last_seq"))
    kept = state.join(newest.select("gauge_id"), "gauge_id", "left_anti")
    moved = after.join(newest, "gauge_id")
    (
        moved.unionByName(kept)
        .write.mode("overwrite")
        .parquet(f"{root}/state/batch_id={batch_id}")
    )
    below.unpersist()
    placed.unpersist()


def corrected(spark: SparkSession, root: str, readings: DataFrame) -> DataFrame:
    """All transitions, those of gauges with late readings worked out anew from ``readings``.

    ``readings`` are all readings so far, the late ones in their places. Columns: gauge_id, seq, at,
    transition.
    """
    again = late_table(spark, root).select("gauge_id").distinct()
    kept = transition_table(spark, root).drop("batch_id").join(again, "gauge_id", "left_anti")
    return kept.unionByName(event_transitions(readings.join(again, "gauge_id", "left_semi")))


def corrected_state(spark: SparkSession, root: str, batch_id: int, readings: DataFrame) -> DataFrame:
    """The state after a batch, that of gauges with late readings from ``readings``."""
    again = late_table(spark, root).select("gauge_id").distinct()
    mine = readings.join(again, "gauge_id", "left_semi")
    last = mine.where(~F.col("stale")).groupBy("gauge_id").agg(F.max("seq").alias("last_seq"))
    kept = state_table(spark, root, batch_id).join(again, "gauge_id", "left_anti")
    return kept.unionByName(event_state(mine).join(last, "gauge_id"))
