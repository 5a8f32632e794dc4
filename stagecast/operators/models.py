"""Direct ridge models, scoring, error metrics and the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecast.constants import HEADLINE_HORIZONS, HORIZONS, QUANTILES, RIDGE_PENALTY
from stagecast.operators.quantiles import exact_quantiles

_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


def _solve(gram: pd.Series, rhs: pd.Series) -> pd.Series:
    """One small linear system per row."""
    return pd.Series(
        [np.linalg.solve(np.stack(g), np.stack(r)).tolist() for g, r in zip(gram, rhs)]
    )


def fit_ridge(
    train: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    penalty: float = RIDGE_PENALTY,
    keys: Sequence[str] = ("target_id",),
) -> DataFrame:
    """One ridge model per key and horizon on standardised features, intercept not penalised.

    One aggregation gives every sum: with centred features the intercept is the label mean and
    the normal equations follow from covariances, which Spark accumulates without cancellation
    and combines before the shuffle. Only the p x p system of each key is solved in Python.
    """
    labels = [f"y_{h}" for h in horizons]

    def cov(a: str, b: str) -> str:
        return f"c_{a}_{b}"

    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = (
        [F.count("*").alias("training_examples")]
        + [F.avg(c).alias(f"m_{c}") for c in (*features, *labels)]
        + [F.covar_pop(a, b).alias(cov(a, b)) for a, b in pairs]
        + [F.covar_pop(a, y).alias(cov(a, y)) for a in features for y in labels]
    )
    moments = train.groupBy(*keys).agg(*sums)

    def scale(c: str) -> Column:
        deviation = F.sqrt(F.col(cov(c, c)))
        return F.when(deviation == 0, 1.0).otherwise(deviation)

    n = F.col("training_examples")
    order = {c: i for i, c in enumerate(features)}

    def gram(a: str, b: str) -> Column:
        first, second = sorted((a, b), key=order.get)
        entry = n * F.col(cov(first, second)) / (scale(a) * scale(b))
        return entry + penalty if a == b else entry

    solve = F.pandas_udf(_solve, _MATRIX)
    return moments.select(
        *keys,
        "training_examples",
        F.array(*[F.col(f"m_{c}") for c in features]).alias("feature_means"),
        F.array(*[scale(c) for c in features]).alias("feature_scales"),
        F.array(*[F.col(f"m_{y}") for y in labels]).alias("intercept"),
        F.array(*[F.array(*[gram(a, b) for b in features]) for a in features]).alias("gram"),
        F.array(
            *[F.array(*[n * F.col(cov(a, y)) / scale(a) for y in labels]) for a in features]
        ).alias("rhs"),
    ).select("*", solve("gram", "rhs").alias("weights")).drop("gram", "rhs")


def linear_center(features: Sequence[Column], position: int) -> Column:
    """Prediction of the model columns on a row, for one horizon position."""
    terms = [
        (x - F.col("feature_means")[j])
        / F.col("feature_scales")[j]
        * F.col("weights")[j][position]
        for j, x in enumerate(features)
    ]
    return reduce(lambda a, b: a + b, terms, F.col("intercept")[position])


def predict(
    examples: DataFrame,
    models: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    keys: Sequence[str] = ("target_id",),
) -> DataFrame:
    """Add ``p_<h>`` columns. The model table is joined by key; its size decides how."""
    columns = [F.col(c) for c in features]
    model = models.select(*keys, "feature_means", "feature_scales", "intercept", "weights")
    return (
        examples.join(model, list(keys))
        .withColumns({f"p_{h}": linear_center(columns, i) for i, h in enumerate(horizons)})
        .drop("feature_means", "feature_scales", "intercept", "weights")
    )


def persistence(examples: DataFrame, current: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return examples.withColumns({f"p_{h}": F.col(current) for h in horizons})


def horizon_mae(
    scored: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("target_id",)
) -> DataFrame:
    """Mean absolute error per horizon, a column each."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("examples"),
        *[F.avg(F.abs(F.col(f"p_{h}") - F.col(f"y_{h}"))).alias(f"mae_{h}") for h in horizons],
    )


def long_mae(mae: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    keep = [c for c in mae.columns if not c.startswith("mae_")]
    return mae.select(
        *keep,
        F.inline(
            F.array(
                *[F.struct(F.lit(h).alias("horizon"), F.col(f"mae_{h}").alias("mae")) for h in horizons]
            )
        ),
    )


def label_thresholds(
    train: DataFrame,
    probability: float = 0.95,
    horizons: Sequence[int] = HORIZONS,
    keys: Sequence[str] = ("target_id",),
) -> DataFrame:
    """Training quantile of the label per horizon: columns ``t_<h>``."""
    long = train.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"y_{h}").alias("y")) for h in horizons])),
    )
    found = exact_quantiles(long, [*keys, "h"], "y", [probability])
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("h") == h, F.col("quantile"))).alias(f"t_{h}") for h in horizons]
    )


def high_stage_mae(
    scored: DataFrame,
    thresholds: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    keys: Sequence[str] = ("target_id",),
) -> DataFrame:
    """Error pooled over horizons where the label reaches its threshold; infinite without any."""

    def pooled(term):
        parts = [
            F.coalesce(F.sum(F.when(F.col(f"y_{h}") >= F.col(f"t_{h}"), term(h))), F.lit(0.0))
            for h in horizons
        ]
        return reduce(lambda a, b: a + b, parts)

    total = pooled(lambda h: F.abs(F.col(f"p_{h}") - F.col(f"y_{h}")))
    count = pooled(lambda h: F.lit(1.0))
    return (
        scored.join(thresholds, list(keys))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.try_divide(total, count), F.lit(float("inf"))).alias("high_stage_mae")
        )
    )


def residual_quantiles(
    scored: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    quantiles: Sequence[float] = QUANTILES,
    keys: Sequence[str] = ("target_id",),
) -> DataFrame:
    """Quantiles of label minus prediction: keys, ``horizon``, ``probability``, ``residual``."""
    long = scored.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(h).alias("horizon"),
                        (F.col(f"y_{h}") - F.col(f"p_{h}")).alias("residual"),
                    )
                    for h in horizons
                ]
            )
        ),
    )
    return exact_quantiles(long, [*keys, "horizon"], "residual", quantiles).select(
        *keys, "horizon", "probability", F.col("quantile").alias("residual")
    )


def residual_offsets(
    residuals: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("target_id",)
) -> DataFrame:
    """``residual_quantile_offsets``: map of quantile label to an array by horizon."""
    label = F.col("probability").cast("string")
    by_quantile = residuals.groupBy(*keys, label.alias("label")).agg(
        F.array(
            *[F.max(F.when(F.col("horizon") == h, F.col("residual"))) for h in horizons]
        ).alias("offsets")
    )
    return by_quantile.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "offsets")))).alias(
            "residual_quantile_offsets"
        )
    )


def pinball(scored_quantiles: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Mean pinball loss of rows ``(quantile, prediction, actual)``."""
    error = F.col("actual") - F.col("prediction")
    q = F.col("quantile")
    return scored_quantiles.groupBy(*keys).agg(
        F.avg(F.greatest(q * error, (q - 1) * error)).alias("pinball_loss")
    )


def paired_errors(pairs: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Discharge regression errors of ``(prediction, actual)``."""
    error = F.col("prediction") - F.col("actual")
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae_cfs"),
        F.sqrt(F.avg(error * error)).alias("rmse_cfs"),
        F.avg(error).alias("signed_bias_cfs"),
    )


def headline_score(mae: DataFrame, horizons: Sequence[int] = HEADLINE_HORIZONS) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f"mae_{h}") for h in horizons])
    return mae.withColumn("headline_mae", total / len(horizons))


def improves(score: Column, best: Column, by: float = 1e-4) -> Column:
    """Whether a score is below the best so far by the required step."""
    return best.isNull() | (score < best - by)


def best_seed(scores: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Seed with the lowest score, the lower seed on ties."""
    return scores.groupBy(*keys).agg(
        F.min(F.struct("score", "seed")).alias("best")
    ).select(*keys, F.col("best.seed").alias("selected_seed"), F.col("best.score").alias("score"))


def promotion_allowed(
    champion: dict[int, Column],
    candidate: dict[int, Column],
    champion_high: Column,
    candidate_high: Column,
    finite: Column | bool = True,
    compatible: Column | bool = True,
) -> Column:
    """The gate: no headline horizon over 5 % worse, 2 % better on average, high stage at most
    5 % worse. Denominators are at least 0.01."""

    def worse(new: Column, old: Column) -> Column:
        return (new - old) / F.greatest(F.lit(0.01), old)

    changes = [worse(candidate[h], champion[h]) for h in HEADLINE_HORIZONS]
    mean_gain = -reduce(lambda a, b: a + b, changes) / len(changes)
    fit = (F.lit(finite) if isinstance(finite, bool) else finite) & (
        F.lit(compatible) if isinstance(compatible, bool) else compatible
    )
    passed = (
        (F.greatest(*changes) <= 0.05)
        & (mean_gain >= 0.02)
        & (worse(candidate_high, champion_high) <= 0.05)
    )
    # two infinite high-stage errors give no number to compare, which does not pass
    comparable = ~F.isnan(worse(candidate_high, champion_high))
    return F.coalesce(fit & passed & comparable, F.lit(False))


def compare(champions: DataFrame, challengers: DataFrame) -> DataFrame:
    """Challengers of each target against its champion.

    Both sides carry ``target_id``, ``mae_<h>`` and ``high_stage_mae``; challengers a ``model``.
    """
    names = [f"mae_{h}" for h in HEADLINE_HORIZONS] + ["high_stage_mae"]
    base = champions.select("target_id", *[F.col(c).alias(f"champion_{c}") for c in names])
    return challengers.join(base, "target_id").withColumn(
        "promotion_allowed",
        promotion_allowed(
            {h: F.col(f"champion_mae_{h}") for h in HEADLINE_HORIZONS},
            {h: F.col(f"mae_{h}") for h in HEADLINE_HORIZONS},
            F.col("champion_high_stage_mae"),
            F.col("high_stage_mae"),
        ),
    )
