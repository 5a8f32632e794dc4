"""The feature set that models are trained on, built from a frozen manifest."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.constants import SPLITS
from stagecast.operators.features import add_upstream, horizon_examples
from stagecast.plans.training import with_split
from stagecast.sources.tables import frozen_lags, require_cutoff, require_unchanged, write_partitioned


class MissingExamples(ValueError):
    pass


def build_feature_set(
    manifest_rows: DataFrame,
    inputs: Mapping[str, DataFrame],
    targets: DataFrame,
    upstream: DataFrame,
    issue_day: Column,
    cutoff: date,
    path: str,
    splits=SPLITS,
    width: int = 1024,
) -> DataFrame:
    """Examples of every target up to the cutoff, written by target; the table read back.

    ``inputs`` are the tables the manifest has fingerprints of; one that changed is refused, and so
    is another cutoff than the frozen one. ``targets`` and ``upstream`` are regular series
    (series, idx, value), ``issue_day`` the day of an ``idx``. Upstream values come in the order of
    the gauges, which ``upstream_gauges`` names with their lags; a target without lags has none. A
    target of the manifest without any example is an error.
    """
    spark = targets.sparkSession
    require_cutoff(manifest_rows, cutoff)
    for name, df in inputs.items():
        require_unchanged(manifest_rows, name, df)
    lags = frozen_lags(manifest_rows)
    named = lags.groupBy("target_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("gauge_id", "lag_hours"))),
            lambda x: F.concat_ws("@", x["gauge_id"], x["lag_hours"]),
        ).alias("upstream_gauges")
    )
    own = horizon_examples(targets, width=width).where(issue_day <= F.lit(cutoff))
    linked = add_upstream(own, upstream, lags).join(named, "target_id")
    alone = own.join(lags.select("target_id").distinct(), "target_id", "left_anti").withColumns(
        {"upstream": F.array().cast("array<double>"), "upstream_gauges": F.array().cast("array<string>")}
    )
    examples = with_split(linked.unionByName(alone), issue_day, cutoff, splits)
    write_partitioned(examples, path, ["target_id"])
    stored = spark.read.schema(examples.schema).parquet(path)
    wanted = lags.select("target_id").union(targets.select("series")).distinct()
    missing = wanted.join(stored.select("target_id").distinct(), "target_id", "left_anti").limit(20).collect()
    if missing:
        raise MissingExamples("no examples of " + ", ".join(sorted(r.target_id for r in missing)))
    return stored
