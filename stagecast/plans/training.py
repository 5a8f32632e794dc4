"""Train, calibrate and compare stage models over all targets at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.constants import HORIZONS, QUANTILES, RIDGE_MODEL, SPLITS
from stagecast.functions.columns import split_of
from stagecast.operators import boosting
from stagecast.operators import models as m
from stagecast.operators.features import TARGET_FEATURES
from stagecast.session import materialise


FITTING = ("training", "validation", "calibration")


def with_split(examples: DataFrame, issue_day, cutoff: date, splits=SPLITS) -> DataFrame:
    """Add ``split`` by issue day; training has no lower bound."""
    return examples.withColumn("split", split_of(issue_day, cutoff, splits, open_start=True))


def _of(examples: DataFrame, split: str) -> DataFrame:
    return examples.where(F.col("split") == split)


class EmptySplit(ValueError):
    pass


def split_counts(examples: DataFrame) -> DataFrame:
    """Examples of each target by split, a column each."""
    return examples.groupBy("target_id").agg(
        *[F.count_if(F.col("split") == name).alias(f"{name}_examples") for name in FITTING]
    )


def require_splits(counts: DataFrame) -> None:
    """Refuse targets that lack a split."""
    lacking = counts.where(F.least(*[f"{name}_examples" for name in FITTING]) == 0).limit(20).collect()
    if lacking:
        raise EmptySplit("a split is empty for " + ", ".join(sorted(r.target_id for r in lacking)))


def _metrics(scored: DataFrame, thresholds: DataFrame, horizons, name: str) -> DataFrame:
    return m.horizon_mae(scored, horizons).join(
        m.high_stage_mae(scored, thresholds, horizons), "target_id", "left"
    ).withColumn("variant", F.lit(name))


def train_ridge(
    examples: DataFrame,
    upstream_features: Sequence[str] = (),
    horizons: Sequence[int] = HORIZONS,
    quantiles: Sequence[float] = QUANTILES,
    target_features: Sequence[str] = TARGET_FEATURES,
) -> dict[str, DataFrame]:
    """Fit both variants, choose by the promotion gate, calibrate the choice.

    Examples carry ``target_id, split``, the features and ``y_<h>``; they are read several times,
    so pass a stored table. A target without examples in one of the splits is refused. Returns
    ``models`` and ``report``, both with the examples of each split.
    """
    sizes = materialise(split_counts(examples), "split-counts")
    require_splits(sizes)
    train, validation, calibration = (
        _of(examples, s) for s in ("training", "validation", "calibration")
    )
    variants = {"target_only": list(target_features)}
    if upstream_features:
        variants["target_plus_upstream"] = [*target_features, *upstream_features]
    # a row per target each, used by every step below
    thresholds = materialise(m.label_thresholds(train, 0.95, horizons), "label-thresholds")
    fitted = {
        name: materialise(m.fit_ridge(train, cols, horizons), f"ridge-{name}")
        for name, cols in variants.items()
    }
    metrics = {
        name: materialise(
            _metrics(m.predict(validation, fitted[name], cols, horizons), thresholds, horizons, name),
            f"metrics-{name}",
        )
        for name, cols in variants.items()
    }
    base = _metrics(
        m.persistence(validation, target_features[0], horizons), thresholds, horizons, "persistence"
    )
    report = base.drop("high_stage_mae").withColumn("high_stage_mae", F.lit(None).cast("double"))
    for one in metrics.values():
        report = report.unionByName(one)
    chosen = examples.select("target_id").distinct().withColumn("selected_variant", F.lit("target_only"))
    if upstream_features:
        challenger = metrics["target_plus_upstream"].withColumnRenamed("variant", "model")
        chosen = m.compare(metrics["target_only"], challenger).select(
            "target_id",
            F.when(F.col("promotion_allowed"), "target_plus_upstream")
            .otherwise("target_only")
            .alias("selected_variant"),
        )
    documents = None
    for name, cols in variants.items():
        selected = fitted[name].join(
            chosen.where(F.col("selected_variant") == name), "target_id"
        )
        offsets = m.residual_offsets(
            m.residual_quantiles(
                m.predict(calibration, selected, cols, horizons), horizons, quantiles
            ),
            horizons,
        )
        document = (
            selected.join(offsets, "target_id")
            .drop(*sizes.columns[1:])
            .join(sizes, "target_id")
            .withColumn("model_type", F.lit(RIDGE_MODEL))
            .withColumn("feature_columns", F.array(*map(F.lit, cols)))
        )
        documents = document if documents is None else documents.unionByName(document)
    return {"models": documents, "report": report.join(chosen, "target_id", "left").join(sizes, "target_id")}


def train_trees(
    sequences: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    quantiles: Sequence[float] = QUANTILES,
    **settings,
) -> dict[str, DataFrame]:
    """Boosted-tree challengers on the change from the latest value, of all targets at once.

    Sequences carry ``target_id, split, history, issued_idx`` and ``y_<h>``; they are read several
    times, so pass a stored table. ``settings`` go to ``boosting.grow``. Returns the ensemble,
    scored rows, the report with the examples of each split and the trees kept, and residual
    quantiles of the calibration rows.
    """
    sizes = split_counts(sequences)
    require_splits(sizes)
    ensemble = boosting.grow(sequences, horizons, **settings)
    fitted = sequences.where(F.col("split").isin(*FITTING))
    scored = boosting.score(fitted, ensemble, horizons)
    kept = ensemble.groupBy("target_id", "horizon").agg(F.max("tree").alias("rounds"))
    used = kept.groupBy("target_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "rounds")))).alias("rounds")
    )
    thresholds = m.label_thresholds(_of(sequences, "training"), 0.95, horizons)
    return {
        "ensemble": ensemble,
        "scored": scored,
        "report": _metrics(_of(scored, "validation"), thresholds, horizons, "boosted_trees")
        .join(sizes, "target_id")
        .join(used, "target_id"),
        "residuals": m.residual_quantiles(_of(scored, "calibration"), horizons, quantiles),
    }
