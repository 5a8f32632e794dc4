"""Three-valued threshold labels over the window after an issue time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecast.constants import DAY, HORIZONS, HOUR, MINUTE
from stagecast.functions.columns import crossed, from_micros, micros
from stagecast.operators.blocks import with_blocks


def _ahead(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Issues with ``most`` and ``count``, arrays over the horizons, of the readings ahead of them.

    For a horizon the axis is cut into cells as wide as the window. A window then is the end of
    one cell, after the issue, and the beginning of the next one, up to the same offset in it, so
    a running maximum from each side of the cells gives it: the work per row and horizon does
    not depend on the window's width. Rows come dealt by gauge and block, and stay so.
    """
    cell = lambda h: F.floor(F.col("us") / (h * HOUR)).cast("bigint")

    def entry(i: int, h: int, part: str, shift: int):
        at = (F.col("us") + shift * h * HOUR).alias("at")
        return F.struct(F.lit(i).alias("i"), (cell(h) + shift).alias("cell"), at, F.lit(part).alias("part"))

    numbered = list(enumerate(horizons))
    asks = F.array(*[entry(i, h, part, shift) for i, h in numbered for part, shift in (("end", 0), ("beginning", 1))])
    holds = F.array(*[entry(i, h, "reading", 0) for i, h in numbered])
    entries = rows.select(
        "gauge_id", "block", "us", "value", "threshold", F.explode(F.when(F.col("issue"), asks).otherwise(holds)).alias("e")
    ).select("gauge_id", "block", "us", "value", "threshold", "e.*").withColumn("back", -F.col("at"))
    inside = Window.partitionBy("gauge_id", "block", "i", "cell")
    upto = inside.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    after = inside.orderBy("back").rangeBetween(Window.unboundedPreceding, -1)
    both = lambda f: F.when(F.col("part") == "end", f("value").over(after)).otherwise(f("value").over(upto))
    found = entries.withColumns({"most": both(F.max), "n": both(F.count)}).where("part <> 'reading'")
    # an issue that is asked for several times is counted that often and given back that often
    each = found.groupBy("gauge_id", "block", "us", "threshold", "i").agg(
        F.max("most").alias("most"), F.sum("n").alias("n"), F.count_if(F.col("part") == "end").alias("copies")
    )
    listed = F.array_sort(F.collect_list(F.struct("i", "most", (F.col("n") / F.col("copies")).cast("bigint").alias("n"))))
    whole = each.groupBy("gauge_id", "block", "us", "threshold").agg(listed.alias("e"), F.max("copies").alias("copies"))
    return whole.select(
        "gauge_id",
        "us",
        "threshold",
        F.transform("e", lambda e: e["most"]).alias("most"),
        F.transform("e", lambda e: e["n"]).alias("count"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def window_labels(
    readings: DataFrame,
    issues: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    interval: int = 15 * MINUTE,
    width: int = 30 * DAY,
) -> DataFrame:
    """Maximum in ``(issued_at, issued_at + h hours]`` and whether it crossed, per horizon.

    Issues are ``(gauge_id, issued_at, threshold)``. True as soon as a reading reaches the
    threshold, false only when every expected reading is there, null otherwise.
    """
    obs = readings.where(F.col("value").isNotNull()).select(
        "gauge_id", micros(F.col("event_time")).alias("us"), "value",
        F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("issue"),
    )
    asked = issues.select(
        "gauge_id", micros(F.col("issued_at")).alias("us"), F.lit(None).cast("double").alias("value"),
        F.col("threshold").cast("double").alias("threshold"), F.lit(True).alias("issue"),
    )
    rows = with_blocks(obs.unionByName(asked), "us", width, after=max(horizons) * HOUR)
    rows = rows.where(F.col("home") | ~F.col("issue")).repartition("gauge_id", "block")
    found = _ahead(rows, horizons)
    per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_hours"),
                F.get("most", F.lit(i)).alias("maximum"),
                F.get("count", F.lit(i)).alias("valid_samples"),
                crossed(
                    F.get("most", F.lit(i)), F.get("count", F.lit(i)), h * HOUR // interval, F.col("threshold")
                ).alias("crossed"),
            )
            for i, h in enumerate(horizons)
        ]
    )
    return found.select(
        "gauge_id", from_micros(F.col("us")).alias("issued_at"), "threshold", F.inline(per_horizon)
    )
