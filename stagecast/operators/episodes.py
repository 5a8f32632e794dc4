"""Threshold episodes, storm clusters, and counts and gates over splits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.constants import (
    DAY,
    HOUR,
    MINUTE,
    REQUIRED_CLUSTERS,
    REQUIRED_EPISODES,
    SPLITS,
)
from stagecast.functions.columns import from_micros, micros, split_containing, split_of
from stagecast.operators.blocks import in_block, with_blocks


def flood_episodes(
    samples: DataFrame,
    threshold: Column | str = "threshold",
    keys: Sequence[str] = ("gauge_id",),
    gap: int = 30 * MINUTE,
    quiet_for: int = 24 * HOUR,
    merge_within: int = 72 * HOUR,
    width: int = 10 * DAY,
) -> DataFrame:
    """Episodes of ``value >= threshold`` in canonical samples (one row per key and event time).

    An episode closes after ``quiet_for`` of readings below the threshold. A null, or a step over
    ``gap``, restarts that wait and marks the end uncertain. Closed episodes less than
    ``merge_within`` apart are merged; one still open at the end stands alone and is uncertain.

    Whether a reading closes an episode depends only on the readings of the last
    ``quiet_for + 3 * gap``, so each block sees that much of the past and is folded by itself to
    a row per closing. Those few rows per block are then put in order per key.
    """
    keys = list(keys)
    us, value = F.col("us"), F.col("value")
    rows = with_blocks(
        samples.select(
            *keys,
            micros(F.col("event_time")).alias("us"),
            "value",
            (F.col(threshold) if isinstance(threshold, str) else threshold).alias("threshold"),
        ),
        "us",
        width,
        before=quiet_for + 3 * gap,
    )
    w = in_block(keys, "us")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(value >= F.col("threshold"), F.lit(False))
    marked = (
        rows.withColumn("above", above)
        .withColumn("prior_us", F.lag("us").over(w))
        # a first reading has no gap, but there a flag changes nothing
        .withColumn("gap", F.coalesce(us - F.col("prior_us") > gap, F.lit(True)))
        .withColumn("quiet", ~F.col("above") & value.isNotNull() & ~F.col("gap"))
        .withColumn("prior_quiet", F.coalesce(F.lag("quiet").over(w), F.lit(False)))
        .withColumn(
            "quiet_from",
            F.last(F.when(F.col("quiet") & ~F.col("prior_quiet"), us), ignorenulls=True).over(w),
        )
        .withColumn(
            "closes",
            F.when(
                F.col("home")
                & F.col("quiet")
                & F.col("prior_quiet")
                & (us - F.col("quiet_from") >= quiet_for)
                & (F.col("prior_us") - F.col("quiet_from") < quiet_for),
                1,
            ).otherwise(0),
        )
        .withColumn("part", F.coalesce(F.sum("closes").over(earlier), F.lit(0)))
        .where("home")
    )
    folded = marked.groupBy(*keys, "block", "part").agg(
        F.min(F.when(F.col("above"), us)).alias("started"),
        F.max(F.when(F.col("above"), us)).alias("last_above"),
        F.max(F.when(F.col("above"), value)).alias("maximum"),
        F.max(F.when(F.col("gap") | value.isNull(), us)).alias("doubtful"),
        F.max("closes").alias("closes"),
    )
    in_order = Window.partitionBy(*keys).orderBy("block", "part")
    episodes = (
        folded.withColumn(
            "episode",
            F.coalesce(
                F.sum("closes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .groupBy(*keys, "episode")
        .agg(
            F.min("started").alias("started"),
            F.max("last_above").alias("last_above"),
            F.max("maximum").alias("maximum"),
            F.max("doubtful").alias("doubtful"),
            (F.max("closes") == 1).alias("closed"),
        )
        .where(F.col("started").isNotNull())
    )
    # at most one episode per ``quiet_for`` of a key from here on
    by_start = Window.partitionBy(*keys, "closed").orderBy("started")
    apart = F.coalesce(
        F.col("started") - F.lag("last_above").over(by_start) >= merge_within, F.lit(True)
    )
    doubt = F.coalesce(F.col("doubtful") > F.col("started"), F.lit(False)) | ~F.col("closed")
    return (
        episodes.withColumn("doubt", doubt)
        .withColumn("apart", apart.cast("int"))
        .withColumn("merged", F.sum("apart").over(by_start))
        .groupBy(*keys, "closed", "merged")
        .agg(
            from_micros(F.min("started")).alias("started_at"),
            from_micros(F.max("last_above")).alias("last_above_at"),
            F.max("maximum").alias("maximum"),
            F.max("doubt").alias("uncertain_end"),
        )
        .drop("closed", "merged")
    )


def _clustered_starts(
    episodes: DataFrame, keys: Sequence[str], margin: int, width: int
) -> DataFrame:
    """Each distinct episode start with the bounds of its cluster.

    Episodes with one start move together, so the sweep runs over distinct starts. A block folds
    them to groups at least ``2 * margin`` long, so the groups left to order are bounded by the
    time span and not by the number of gauges.
    """
    starts = (
        episodes.groupBy(*keys, micros(F.col("started_at")).alias("started"))
        .agg(F.max(micros(F.col("last_above_at"))).alias("last"))
        .withColumn("opens", F.col("started") - margin)
        .withColumn("ends", F.col("last") + margin)
    )

    def grouped(df: DataFrame, w, order: str, label: str) -> DataFrame:
        reach = F.max("ends").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        new = F.coalesce(F.col("opens") > reach, F.lit(True)).cast("int")
        return df.withColumn("new", new).withColumn(
            label, F.sum("new").over(w.orderBy(order))
        ).drop("new")

    local = grouped(
        with_blocks(starts, "started", width).drop("home"),
        Window.partitionBy(*keys, "block"),
        "started",
        "part",
    )
    parts = local.groupBy(*keys, "block", "part").agg(
        F.min("opens").alias("opens"), F.max("ends").alias("ends")
    )
    whole = grouped(parts, Window.partitionBy(*keys), "opens", "cluster")
    bounds = whole.groupBy(*keys, "cluster").agg(
        F.min("opens").alias("cluster_opens"), F.max("ends").alias("cluster_ends")
    )
    return (
        local.select(*keys, "block", "part", "started")
        .join(whole.select(*keys, "block", "part", "cluster"), [*keys, "block", "part"])
        .join(bounds, [*keys, "cluster"])
        .select(*keys, "started", "cluster_opens", "cluster_ends")
    )


def storm_cluster_members(
    episodes: DataFrame,
    keys: Sequence[str] = (),
    margin: int = 72 * HOUR,
    width: int = 30 * DAY,
) -> DataFrame:
    """Clusters of episodes widened by the margin, across gauges: a row per cluster and gauge.

    Touching intervals join. ``keys`` separates independent clusterings (one per threshold).
    """
    keys = list(keys)
    starts = _clustered_starts(episodes, keys, margin, width)
    return (
        episodes.withColumn("started", micros(F.col("started_at")))
        .join(starts, [*keys, "started"])
        .groupBy(*keys, "cluster_opens", "cluster_ends", "gauge_id")
        .agg(F.count("*").alias("episode_count"))
        .select(
            *keys,
            from_micros(F.col("cluster_opens")).alias("started_at"),
            from_micros(F.col("cluster_ends")).alias("ended_at"),
            "gauge_id",
            "episode_count",
        )
    )


def storm_clusters(
    episodes: DataFrame,
    keys: Sequence[str] = (),
    margin: int = 72 * HOUR,
    width: int = 30 * DAY,
) -> DataFrame:
    """One row per cluster; its gauges sorted, its episodes counted.

    The array holds each gauge once. ``storm_cluster_members`` gives the same as rows.
    """
    members = storm_cluster_members(episodes, keys, margin, width)
    return members.groupBy(*keys, "started_at", "ended_at").agg(
        F.array_sort(F.collect_set("gauge_id")).alias("gauge_ids"),
        F.sum("episode_count").alias("episode_count"),
    )


def cluster_bounds(members: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per cluster of ``storm_cluster_members``: bounds, number of gauges and of episodes.

    Counts combine before the shuffle, so a cluster that holds nearly every gauge stays one row
    of two numbers; its gauges are the member rows.
    """
    return members.groupBy(*keys, "started_at", "ended_at").agg(
        F.count("*").alias("gauge_count"), F.sum("episode_count").alias("episode_count")
    )


def episode_split(cutoff: date, splits=SPLITS) -> Column:
    """Split of an episode, by the UTC day of its midpoint."""
    start, last = micros(F.col("started_at")), micros(F.col("last_above_at"))
    middle = from_micros(start + F.floor((last - start) / 2).cast("bigint"))
    return split_of(middle.cast("date"), cutoff, splits)


def _split_spine(df: DataFrame, splits) -> DataFrame:
    return df.withColumn("split", F.explode(F.array(*[F.lit(name) for name, _, _ in splits])))


def episodes_by_split(
    episodes: DataFrame,
    gauges: DataFrame,
    cutoff: date,
    keys: Sequence[str] = ("gauge_id",),
    splits=SPLITS,
) -> DataFrame:
    """Episodes per key and split, zeros included."""
    counts = (
        episodes.groupBy(*keys, episode_split(cutoff, splits).alias("split"))
        .agg(F.count("*").alias("episodes"))
        .where(F.col("split").isNotNull())
    )
    return (
        _split_spine(gauges.select(*keys).distinct(), splits)
        .join(counts, [*keys, "split"], "left")
        .withColumn("episodes", F.coalesce("episodes", F.lit(0).cast("bigint")))
    )


def clusters_by_split(
    clusters: DataFrame, cutoff: date, keys: Sequence[str] = (), splits=SPLITS
) -> DataFrame:
    """Clusters inside each split; the null split counts those that touch a boundary."""
    where = split_containing(F.col("started_at"), F.col("ended_at"), cutoff, splits)
    return clusters.groupBy(*keys, where.alias("split")).agg(F.count("*").alias("clusters"))


def pooled_gate(
    cluster_counts: DataFrame,
    keys: Sequence[str] = ("threshold_name",),
    required=REQUIRED_CLUSTERS,
) -> DataFrame:
    """Whether the pooled clusters reach the required number in every named split."""
    seen = [
        F.coalesce(F.sum(F.when(F.col("split") == name, F.col("clusters"))), F.lit(0)) >= least
        for name, least in required.items()
    ]
    passed = seen[0]
    for one in seen[1:]:
        passed = passed & one
    return cluster_counts.groupBy(*keys).agg(passed.alias("pooled_gate_passed"))


def target_gate(
    episode_counts: DataFrame,
    pooled: DataFrame,
    keys: Sequence[str] = ("threshold_name",),
    required=REQUIRED_EPISODES,
) -> DataFrame:
    """Per gauge: eligible when the pooled gate passed and it has enough episodes of its own."""
    enough = F.lit(True)
    for name, least in required.items():
        enough = enough & (
            F.coalesce(F.sum(F.when(F.col("split") == name, F.col("episodes"))), F.lit(0)) >= least
        )
    per_gauge = episode_counts.groupBy(*keys, "gauge_id").agg(enough.alias("enough_episodes"))
    return per_gauge.join(pooled, list(keys), "left").withColumn(
        "eligible",
        F.coalesce(F.col("pooled_gate_passed"), F.lit(False)) & F.col("enough_episodes"),
    )


def overall_gate(gated: DataFrame, keys: Sequence[str] = ("threshold_name",)) -> DataFrame:
    """Eligible as a whole only when every gauge is; and the status text of the audit."""
    return gated.groupBy(*keys).agg(
        F.bool_and("eligible").alias("eligible"),
        F.count_if(F.col("eligible")).alias("eligible_targets"),
        F.when(F.bool_or("eligible"), "eligible_for_calibration_experiment")
        .otherwise("insufficient_events")
        .alias("status"),
    )
