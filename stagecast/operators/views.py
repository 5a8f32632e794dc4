"""Read views over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.operators.revisions import latest_by


def basin_for(basins: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Basins by any of their identifiers: ``(identifier)`` rows against slug, gauge or point id."""
    known = basins.select(
        F.explode(F.array_distinct(F.array("slug", "gauge_id", "nwps_id"))).alias("identifier"), "*"
    )
    return identifiers.join(known, "identifier")


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    """Newest forecast of each target."""
    return latest_by(forecasts, ["target_id"], F.col("issued_at").desc(), F.col("id"))


def forecast_by_id(forecasts: DataFrame, forecast_id: str) -> DataFrame:
    return forecasts.where(F.col("id") == forecast_id)


def event_page(log: DataFrame, after: int, limit: int = 100) -> DataFrame:
    """Next page of the event log past a cursor."""
    return log.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def verification(basins: DataFrame, reports: DataFrame) -> DataFrame:
    """Latest report of every basin that has one; of several at one time the smallest by its values."""
    values = sorted(set(reports.columns) - {"target_id", "reported_at"})
    newest = latest_by(reports, ["target_id"], F.col("reported_at").desc(), *map(F.col, values))
    return basins.select(F.col("gauge_id").alias("target_id"), "target_name").join(newest, "target_id")
