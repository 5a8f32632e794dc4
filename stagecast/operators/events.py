"""Event confirmation: opens on a crossing, closes after three distinct batches below."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecast.operators.blocks import before_block, in_block, with_blocks

OPENED, RESOLVED, STALE = "observed_flooding", "resolved", "unknown_stale"
BATCHES_TO_CLOSE = 3


def _islands(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Readings with their island inside a block, and each block's number of earlier islands.

    An island starts at every reading at or above the threshold.
    """
    fresh = with_blocks(
        rows.where(~F.col("stale")).withColumn("above", F.col("stage") >= F.col("threshold")),
        "seq",
        width,
    ).drop("home")
    w = in_block(["gauge_id"], "seq")
    local = fresh.withColumn("part", F.sum(F.col("above").cast("int")).over(w)).withColumn(
        "after_above", F.coalesce(F.lag("above").over(w), F.lit(False))
    )
    earlier = before_block(
        fresh.groupBy("gauge_id", "block").agg(F.count_if("above").alias("earlier")),
        ["gauge_id"],
        sums=["earlier"],
    )
    return local, earlier


def _below_batches(local: DataFrame, earlier: DataFrame) -> DataFrame:
    """First appearance of the first few distinct batches below, per island."""
    # only the first few batches of an island matter, so a block passes on no more than those
    by_part = Window.partitionBy("gauge_id", "block", "part").orderBy("first")
    firsts = (
        local.where(~F.col("above"))
        .groupBy("gauge_id", "block", "part", "batch_id")
        .agg(F.min(F.struct("seq", "at")).alias("first"))
        .withColumn("n", F.row_number().over(by_part))
        .where(F.col("n") <= BATCHES_TO_CLOSE)
    )
    by_island = Window.partitionBy("gauge_id", "island").orderBy("first")
    return (
        firsts.join(earlier, ["gauge_id", "block"])
        .groupBy("gauge_id", (F.col("earlier") + F.col("part")).alias("island"), "batch_id")
        .agg(F.min("first").alias("first"))
        .withColumn("n", F.row_number().over(by_island))
        .where(F.col("n") <= BATCHES_TO_CLOSE)
    )


def event_transitions(rows: DataFrame, width: int = 100_000) -> DataFrame:
    """Transitions of readings ``(gauge_id, seq, at, batch_id, stage, threshold, stale)``.

    ``seq`` orders a gauge's readings and is unique in it. A reading at or above the threshold
    opens an event unless one is open, and clears the batches below; the third distinct batch
    below closes it. Stale readings are reported and change nothing.
    """
    local, earlier = _islands(rows, width)
    return _transitions(rows, local, earlier, _below_batches(local, earlier))


def _transitions(rows: DataFrame, local: DataFrame, earlier: DataFrame, below: DataFrame) -> DataFrame:
    resolved = (
        below.where((F.col("n") == BATCHES_TO_CLOSE) & (F.col("island") > 0))
        .select("gauge_id", "island", F.col("first.seq").alias("seq"), F.col("first.at").alias("at"))
    )
    starts = (
        local.where(F.col("above") & ~F.col("after_above"))
        .join(earlier, ["gauge_id", "block"])
        .select("gauge_id", (F.col("earlier") + F.col("part")).alias("island"), "seq", "at")
    )
    first = starts.where(F.col("island") == 1)
    again = starts.join(
        resolved.select("gauge_id", (F.col("island") + 1).alias("island")),
        ["gauge_id", "island"],
        "left_semi",
    )

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select("gauge_id", "seq", "at", F.lit(name).alias("transition"))

    return (
        named(first, OPENED)
        .unionByName(named(again, OPENED))
        .unionByName(named(resolved, RESOLVED))
        .unionByName(named(rows.where("stale"), STALE))
    )


def event_state(rows: DataFrame, width: int = 100_000) -> DataFrame:
    """State after the last reading: ``open`` and the distinct batches below since the last crossing."""
    local, earlier = _islands(rows, width)
    return _state(local, _below_batches(local, earlier))


def transitions_and_state(rows: DataFrame, width: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both of the same readings, and the table of batches below that they share.

    The table holds at most three rows per reading at or above the threshold. A caller that runs both
    persists it, so that it is worked out once.
    """
    local, earlier = _islands(rows, width)
    below = _below_batches(local, earlier)
    return _transitions(rows, local, earlier, below), _state(local, below), below


def _state(local: DataFrame, below: DataFrame) -> DataFrame:
    islands = local.groupBy("gauge_id").agg(F.count_if("above").alias("island"))
    below = below.groupBy("gauge_id", "island").agg(F.array_sort(F.collect_list("batch_id")).alias("below_batches"))
    return (
        islands.join(below, ["gauge_id", "island"], "left")
        .withColumn("below_batches", F.coalesce("below_batches", F.array().cast("array<string>")))
        .select(
            "gauge_id",
            (
                (F.col("island") > 0) & (F.size("below_batches") < BATCHES_TO_CLOSE)
            ).alias("open"),
            "below_batches",
        )
    )
