"""Triggers that belong together, and risk events with hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.constants import DAY, MINUTE
from stagecast.functions.columns import micros
from stagecast.operators.blocks import before_block, in_block, numbered, with_blocks

RISK_OPENED, RISK_CLOSED = "risk_opened", "risk_closed"


def coalesced_triggers(triggers: DataFrame, gap: int = 5 * MINUTE, width: int = DAY) -> DataFrame:
    """Triggers ``(target_id, at, kind)`` at most ``gap`` after the one before, as one row each group.

    Columns: target_id, first_at, last_at, triggers, kinds (sorted, each once). Whether a trigger
    starts a group is seen within ``gap``, so a block sees that much of the one before; groups are
    numbered by the starts of earlier blocks. Triggers without a target or a time are left out.
    """
    rows = triggers.where("target_id IS NOT NULL AND at IS NOT NULL").withColumn("us", micros(F.col("at")))
    w = in_block(["target_id"], "us")
    starts = F.coalesce(F.col("us") - F.lag("us").over(w) > gap, F.lit(True)).cast("int")
    marked = with_blocks(rows, "us", width, before=gap).withColumn("starts", starts).where("home")
    local = marked.withColumn("part", F.sum("starts").over(w))
    earlier = before_block(
        marked.groupBy("target_id", "block").agg(F.sum("starts").alias("earlier")), ["target_id"], sums=["earlier"]
    )
    return (
        local.join(earlier, ["target_id", "block"])
        .select("target_id", "at", "kind", (F.col("earlier") + F.col("part")).alias("group"))
        .groupBy("target_id", "group")
        .agg(
            F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("triggers"),
            F.array_sort(F.collect_set("kind")).alias("kinds"),
        )
        .drop("group")
    )


def risk_events(
    issues: DataFrame, above: Column, opens_after: int = 2, closes_after: int = 3, width: int = 10_000
) -> DataFrame:
    """Openings and closings of risk events over the forecasts ``(target_id, issued_at)``.

    An event opens at the second issue in a row that is above and closes at the third in a row
    below; issues where ``above`` is null say nothing. A row that completes such a run settles the
    state whatever came before, so the state is that of the last settling row: an associative
    fold, carried over blocks of issues as one value each.
    """
    known = issues.select("target_id", "issued_at", above.alias("above"), micros(F.col("issued_at")).alias("us"))
    placed = numbered(known.where(F.col("above").isNotNull()), ["target_id"], "us", 100 * DAY)
    reach = max(opens_after, closes_after) - 1
    rows = with_blocks(placed, "row_index", width, before=reach)
    w = in_block(["target_id"], "row_index")

    def run(n: int, flag: Column) -> Column:
        last = w.rowsBetween(-(n - 1), 0)
        return (F.count_if(flag).over(last) == n) & (F.count("*").over(last) == n)

    settles = F.when(run(opens_after, F.col("above")), True).when(run(closes_after, ~F.col("above")), False)
    settled = rows.withColumn("settles", settles).where("home")
    was = F.last("settles", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = before_block(
        settled.groupBy("target_id", "block").agg(
            F.max_by("settles", F.when(F.col("settles").isNotNull(), F.col("row_index"))).alias("carried")
        ),
        ["target_id"],
        lasts=["carried"],
    )
    changed = F.col("settles") != F.coalesce("was", "carried", F.lit(False))
    return (
        settled.withColumn("was", was)
        .join(carried, ["target_id", "block"])
        .where(changed)
        .select("target_id", "issued_at", F.when(F.col("settles"), RISK_OPENED).otherwise(RISK_CLOSED).alias("transition"))
    )
