"""Shadow cycles: issue forecasts for every target and keep what was refused."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.constants import HORIZONS, HOUR, LOOKBACK_HOURS, STAGE
from stagecast.functions.columns import micros, step_index
from stagecast.operators import forecast as f
from stagecast.operators.features import live_histories
from stagecast.operators.revisions import canonical, scan
from stagecast.operators.series import step_means
from stagecast.sources.tables import merge_forecasts


def shadow_cycle(
    revisions: DataFrame,
    models: DataFrame,
    basins: DataFrame,
    stored: DataFrame | None,
    issued_at: datetime,
    hours: int = 3,
    horizons: Sequence[int] = HORIZONS,
    mode: str = "direct",
    source: str | None = None,
) -> dict[str, DataFrame]:
    """Ridge forecasts of all basins ``(target_id, flood_stage_ft)`` at one issue time.

    Only stage readings of the last ``hours`` up to the issue count, of one source if given.
    """
    at = F.lit(issued_at)
    recent = canonical(_until(revisions, at, hours, source))
    issues = basins.select(F.col("target_id").alias("gauge_id"), at.alias("issued_at"))
    state = f.issue_state(recent, issues)
    issued = f.ridge_forecasts(state, models, basins, horizons, mode=mode)
    return {
        "forecasts": issued if stored is None else merge_forecasts(stored, issued),
        "summary": issued.select("target_id", "id", "newest_observation_at", "freshness"),
        "refused": f.refusals(state, needs_prior=True),
    }


def _until(revisions: DataFrame, at, hours: int, source: str | None) -> DataFrame:
    """Stage revisions of the hours up to and at a time."""
    first = at - F.make_dt_interval(hours=F.lit(hours))
    return scan(revisions, parameter=STAGE, source=source, start=first, before=at + F.expr("interval 1 microsecond"))


def challenger_inputs(
    revisions: DataFrame,
    targets: DataFrame,
    issued_at: datetime,
    lookback: int = LOOKBACK_HOURS,
    source: str | None = None,
) -> dict[str, DataFrame]:
    """Live histories of all targets ``(target_id)`` at one issue time, and the rejected ones.

    Histories are hourly means of stage readings; a missing hour rejects a target. ``reason`` is a
    code, ``first_missing_at`` the start of the first hour without a reading.
    """
    rows = canonical(_until(revisions, F.lit(issued_at), lookback + 1, source)).join(
        targets.select(F.col("target_id").alias("gauge_id")), "gauge_id", "left_semi"
    )
    issues = targets.select(
        F.col("target_id").alias("series"), step_index(micros(F.lit(issued_at)), HOUR).alias("issued_idx")
    )
    found = live_histories(step_means(rows), issues, lookback)
    return {
        "histories": found.where(F.col("history").isNotNull()),
        "failures": found.where(F.col("history").isNull()).select(
            F.col("series").alias("target_id"),
            F.lit("incomplete history").alias("reason"),
            F.timestamp_micros(F.col("first_missing_idx") * HOUR).alias("first_missing_at"),
        ),
    }
