"""Shadow forecasts of fitted challengers on live histories, kept apart from public forecasts.

A cycle scores every target's live history with its ensemble and gives records and, for each
target that cannot be scored, a failure with a code. Both are appended by issue time; a cycle
that runs again adds nothing to what is stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import HEADLINE_HORIZONS, HORIZONS, HOUR
from stagecast.functions.columns import from_micros
from stagecast.operators import boosting
from stagecast.operators import models as m
from stagecast.operators.features import live_histories
from stagecast.session import materialise

#: Why a target has no record.
INCOMPLETE, NO_MODEL, OTHER_LENGTH = "incomplete history", "no model", "other history length"
RECORD_KEY = ("target_id", "issued_idx", "model", "horizon", "quantile")
FAILURE_KEY = ("target_id", "issued_idx", "model")


def lookbacks(ensemble: DataFrame, lookback: int) -> DataFrame:
    """(target_id, lookback) of the targets an ensemble was fitted for."""
    return ensemble.select("target_id").distinct().withColumn("lookback", F.lit(lookback))


def cycle(
    series: DataFrame,
    issues: DataFrame,
    ensemble: DataFrame,
    residuals: DataFrame,
    fitted: DataFrame,
    lookback: int,
    model: str = "boosted_trees",
    horizons: Sequence[int] = HORIZONS,
) -> dict[str, DataFrame]:
    """Records and failures of the issues ``(target_id, issued_idx)`` on a step series.

    ``ensemble`` and ``residuals`` (target_id, horizon, probability, residual) are a model's
    tables, ``fitted`` the history length it was fitted on (target_id, lookback). Records are
    ``(target_id, issued_idx, input_ends_idx, model, horizon, quantile, value)``, the centre plus
    the residual quantile and not below zero; failures ``(target_id, issued_idx, model, reason,
    first_missing_idx)``. A history with a gap fails for every model, so its model is null.
    """
    wanted = issues.select(F.col("target_id").alias("series"), "issued_idx")
    found = live_histories(series, wanted, lookback).withColumnRenamed("series", "target_id").join(fitted, "target_id", "left")
    reason = (
        F.when(F.col("history").isNull(), INCOMPLETE)
        .when(F.col("lookback").isNull(), NO_MODEL)
        .when(F.col("lookback") != F.size("history"), OTHER_LENGTH)
    )
    found = found.withColumn("reason", reason)
    failures = found.where(F.col("reason").isNotNull()).select(
        "target_id",
        "issued_idx",
        F.when(F.col("reason") != INCOMPLETE, F.lit(model)).alias("model"),
        "reason",
        "first_missing_idx",
    )
    ready = found.where(F.col("reason").isNull()).select("target_id", "issued_idx", "input_ends_idx", "history")
    scored = boosting.score(ready, ensemble, horizons)
    centres = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"p_{h}").alias("centre")) for h in horizons])
    long = scored.select("target_id", "issued_idx", "input_ends_idx", F.inline(centres))
    records = long.join(residuals, ["target_id", "horizon"]).select(
        "target_id",
        "issued_idx",
        "input_ends_idx",
        F.lit(model).alias("model"),
        "horizon",
        F.col("probability").alias("quantile"),
        F.greatest(F.lit(0.0), F.col("centre") + F.col("residual")).alias("value"),
    )
    return {"records": records, "failures": failures}


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that cycles have appended to, or None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append(rows: DataFrame, path: str, keys: Sequence[str], step: int = HOUR) -> int:
    """Append the rows whose keys are not stored yet, in a folder per day of issue; their number.

    Only folders of the new rows' days are looked at. Null keys are compared as values.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates(list(keys)).withColumn("issued_on", from_micros(F.col("issued_idx") * step).cast("date"))
    known = stored(spark, path)
    if known is not None:
        there = known.join(rows.select("issued_on").distinct(), "issued_on", "left_semi")
        there = there.select(*[F.col(k).alias(f"known_{k}") for k in keys])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys])
        rows = rows.join(there, same, "left_anti")
    new = materialise(rows, "new-rows")
    new.write.mode("append").partitionBy("issued_on").parquet(path)
    return new.count()


def append_cycle(found: dict[str, DataFrame], folder: str, step: int = HOUR) -> dict[str, int]:
    """Store a cycle's records and failures; the numbers of rows added."""
    return {
        "records": append(found["records"], f"{folder}/records", RECORD_KEY, step),
        "failures": append(found["failures"], f"{folder}/failures", FAILURE_KEY, step),
    }


def comparison(ridge_report: DataFrame, challengers: DataFrame, period: tuple[str, str]) -> DataFrame:
    """Each challenger against the target-only ridge of its target, a row per target and challenger.

    Both reports carry ``target_id, variant``, ``mae_<h>`` and ``high_stage_mae`` of the validation
    rows. The test split is never part of a report.
    """
    champions = ridge_report.where(F.col("variant") == "target_only")
    tried = challengers.withColumn("model", F.col("variant"))
    names = [f"mae_{h}" for h in HEADLINE_HORIZONS] + ["high_stage_mae"]
    return m.compare(champions, tried).select(
        "target_id",
        "model",
        *names,
        F.lit("ridge_target_only").alias("champion"),
        *[f"champion_{c}" for c in names],
        "promotion_allowed",
        F.lit(period[0]).alias("first_day"),
        F.lit(period[1]).alias("last_day"),
        F.lit(False).alias("held_out_test_used"),
    )
