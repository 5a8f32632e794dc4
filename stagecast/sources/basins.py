"""The basin dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagecast.constants import BASINS
from stagecast.schemas import BASIN


def basins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(b) for b in BASINS], BASIN)
