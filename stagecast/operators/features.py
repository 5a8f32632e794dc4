"""Causal examples from regular series ``(series, idx, value)``.

Frames reach a bounded number of steps, so every example comes from one shuffle by
(series, block) with a thin overlap, not from a join per horizon.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.constants import HORIZONS, LOOKBACK_HOURS
from stagecast.functions.columns import relative_history
from stagecast.operators.blocks import every_nth, in_block, with_blocks

TARGET_FEATURES = ("target_stage_ft", "target_change_1h_ft")


def label_names(horizons: Sequence[int] = HORIZONS) -> list[str]:
    return [f"y_{h}" for h in horizons]


def horizon_examples(
    series: DataFrame, horizons: Sequence[int] = HORIZONS, width: int = 1024
) -> DataFrame:
    """Tabular examples: value, change from one step earlier, and the value at each horizon.

    A row needs the previous step and every horizon. The step itself is the issue time, as in the
    tabular models; sequences shift the issue by one step (``sequence_examples``).
    """
    w = in_block(["series"], "idx")

    def at(offset: int):
        return F.max("value").over(w.rangeBetween(offset, offset))

    wide = with_blocks(series, "idx", width, before=1, after=max(horizons))
    labels = {f"y_{h}": at(h) for h in horizons}
    complete = F.col("home") & F.col("prior").isNotNull()
    for name in labels:
        complete = complete & F.col(name).isNotNull()
    return (
        wide.withColumns({"prior": at(-1), **labels})
        .where(complete)
        .select(
            F.col("series").alias("target_id"),
            "idx",
            F.col("value").alias("target_stage_ft"),
            (F.col("value") - F.col("prior")).alias("target_change_1h_ft"),
            *labels,
        )
    )


def add_upstream(examples: DataFrame, upstream: DataFrame, lags: DataFrame) -> DataFrame:
    """Add ``upstream``: each linked gauge's value ``lag_hours`` before issue, by gauge id.

    Lags are ``(target_id, gauge_id, lag_hours)``. A row with any of them missing is dropped.
    """
    shifted = upstream.withColumnRenamed("series", "gauge_id").join(lags, "gauge_id").select(
        "target_id",
        (F.col("idx") + F.col("lag_hours")).alias("idx"),
        F.struct("gauge_id", "value").alias("entry"),
    )
    needed = lags.groupBy("target_id").agg(F.count("*").alias("needed"))
    entries = shifted.groupBy("target_id", "idx").agg(
        F.array_sort(F.collect_list("entry")).alias("entries")
    )
    return (
        examples.join(entries, ["target_id", "idx"])
        .join(needed, "target_id")
        .where(F.size("entries") == F.col("needed"))
        .withColumn("upstream", F.transform("entries", lambda e: e["value"]))
        .drop("entries", "needed")
    )


def upstream_names(lags: Sequence[tuple[str, int]]) -> list[str]:
    """Column names of one target's upstream features, ``(gauge, lag)`` pairs given."""
    return [f"upstream_{gauge}_cfs_lag_{lag}h" for gauge, lag in sorted(lags)]


def name_upstream(examples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Spread the ``upstream`` array over named columns."""
    return examples.select(
        *[c for c in examples.columns if c != "upstream"],
        *[F.col("upstream")[i].alias(name) for i, name in enumerate(names)],
    )


def sequence_examples(
    series: DataFrame,
    lookback: int = LOOKBACK_HOURS,
    horizons: Sequence[int] = HORIZONS,
    width: int = 4096,
) -> DataFrame:
    """Histories of ``lookback`` steps without a gap, and the value at each horizon.

    A step's mean is known when the next step begins, so ``issued_idx`` is one past the history's
    end and horizons count from there. Values are single precision.
    """
    examples = _issues(series, lookback, horizons, width, {"history": F.collect_list("value")})
    return examples.select("target_id", "issued_idx", "history", *label_names(horizons))


def _single(series: DataFrame) -> DataFrame:
    return series.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("float"))


def _issues(
    series: DataFrame, lookback: int, horizons: Sequence[int], width: int, over_history: dict[str, Column]
) -> DataFrame:
    """Issues with a whole history and every label; ``over_history`` is worked out over the history.

    ``block`` and ``place`` tell where the history ends: in which block, as which of its readings.
    """
    w = in_block(["series"], "idx")
    back = w.rangeBetween(-(lookback - 1), 0)
    labels = {
        f"y_{h}": F.max("value").over(w.rangeBetween(h + 1, h + 1)) for h in horizons
    }
    complete = F.col("home") & (F.col("steps") == lookback)
    for name in labels:
        complete = complete & F.col(name).isNotNull()
    return (
        with_blocks(_single(series), "idx", width, before=lookback - 1, after=max(horizons) + 1)
        .withColumns(
            {
                "steps": F.count("value").over(back),
                "place": F.row_number().over(w),
                **{name: found.over(back) for name, found in over_history.items()},
                **labels,
            }
        )
        .where(complete)
        .select(
            F.col("series").alias("target_id"),
            (F.col("idx") + 1).alias("issued_idx"),
            "block",
            "place",
            *over_history,
            *labels,
        )
    )


def thinned_examples(
    series: DataFrame,
    every: int,
    split: Callable[[DataFrame], DataFrame],
    lookback: int = LOOKBACK_HOURS,
    horizons: Sequence[int] = HORIZONS,
    width: int = 4096,
) -> DataFrame:
    """Every n-th of the ``sequence_examples`` of a target and split, in order of issue.

    ``split`` adds a column of that name and drops rows outside all splits. Issues are numbered
    without their histories; those that stay are cut from their block's readings, which lie in one
    array of at most ``width + lookback`` values, so no history is built to be dropped.
    """
    found = split(_issues(series, lookback, horizons, width, {}).withColumnRenamed("block", "cell"))
    kept = every_nth(found, ["target_id", "split"], "issued_idx", every, width)
    blocks = with_blocks(_single(series), "idx", width, before=lookback - 1)
    packed = blocks.groupBy(F.col("series").alias("target_id"), F.col("block").alias("cell")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("readings")
    )
    history = F.transform(
        F.slice("readings", F.col("place") - lookback + 1, F.lit(lookback)), lambda r: r["value"]
    )
    return kept.join(packed, ["target_id", "cell"]).select(
        "target_id", "issued_idx", history.alias("history"), *label_names(horizons), "split"
    )


def live_histories(
    series: DataFrame, issues: DataFrame, lookback: int = LOOKBACK_HOURS, width: int = 4096
) -> DataFrame:
    """History of fully elapsed steps for each ``(series, issued_idx)``.

    ``issued_idx`` is the step the issue time falls in; the history ends one step before. Rows
    with a gap keep a null history and name the first missing step. Issues go into the blocks of
    the readings, so one shuffle brings both together.
    """
    readings = series.where(F.col("value").isNotNull()).select(
        "series", "idx", F.col("value").cast("float").alias("value"), F.lit(False).alias("issue")
    )
    wanted = issues.select("series", F.col("issued_idx").alias("idx")).distinct()
    both = readings.unionByName(
        wanted.withColumns({"value": F.lit(None).cast("float"), "issue": F.lit(True)})
    )
    back = in_block(["series"], "idx").rangeBetween(-lookback, -1)
    step = F.when(~F.col("issue"), F.struct("idx", "value"))
    first = F.col("idx") - lookback
    # the steps come in order, so the first one that is missing is where counting up stops
    reached = F.aggregate("steps", first, lambda at, s: F.when(s["idx"] == at, at + 1).otherwise(at))
    return (
        with_blocks(both, "idx", width, before=lookback)
        .withColumn("steps", F.collect_list(step).over(back))
        .where(F.col("home") & F.col("issue"))
        .select(
            "series",
            F.col("idx").alias("issued_idx"),
            (F.col("idx") - 1).alias("input_ends_idx"),
            F.when(F.size("steps") == lookback, F.transform("steps", lambda s: s["value"])).alias("history"),
            F.when(F.size("steps") < lookback, reached).alias("first_missing_idx"),
        )
    )


def sequence_scales(
    thinned: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("target_id",)
) -> DataFrame:
    """Input and target scales of sequences relative to their last value (population deviation).

    The input scale pools every step of every history, so sums and squares are added up inside a
    row first and no row is exploded.
    """
    relative = relative_history(F.transform("history", lambda v: v.cast("double")))
    last = F.element_at("history", -1).cast("double")
    rows = thinned.withColumn("rel", relative).select(
        *keys,
        F.size("rel").alias("n"),
        F.aggregate("rel", F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate("rel", F.lit(0.0), lambda a, v: a + v * v).alias("ss"),
        *[(F.col(f"y_{h}").cast("double") - last).alias(f"d_{h}") for h in horizons],
    )
    mean = F.sum("s") / F.sum("n")
    variance = F.greatest(F.lit(0.0), F.sum("ss") / F.sum("n") - mean * mean)

    def nonzero(column):
        return F.when(column == 0, 1.0).otherwise(column)

    return rows.groupBy(*keys).agg(
        F.count("*").alias("training_examples"),
        nonzero(F.sqrt(variance)).alias("input_scale"),
        *[nonzero(F.stddev_pop(f"d_{h}")).alias(f"target_scale_{h}") for h in horizons],
    )


def normalise_sequences(
    examples: DataFrame, scales: DataFrame, horizons: Sequence[int] = HORIZONS, keep: Sequence[str] = ()
) -> DataFrame:
    """Histories and labels relative to the last value, divided by the fitted scales.

    ``keep`` names further columns of the examples to hand on, such as their split.
    """
    last = F.element_at("history", -1)
    return examples.join(scales, "target_id").select(
        "target_id",
        "issued_idx",
        last.alias("current"),
        F.transform(
            "history", lambda v: ((v - last) / F.col("input_scale")).cast("float")
        ).alias("x"),
        F.array(
            *[((F.col(f"y_{h}") - last) / F.col(f"target_scale_{h}")).cast("float") for h in horizons]
        ).alias("y"),
        *keep,
    )
