"""Bulk forecasts: every gauge at every issue time, as one query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import exp
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.constants import (
    DAY,
    HORIZONS,
    HOUR,
    MINUTE,
    PERSISTENCE_MODEL,
    PERSISTENCE_OFFSETS,
    QUANTILES,
    RIDGE_MODEL,
)
from stagecast.functions.columns import (
    degradation_reasons,
    freshness,
    iso_utc,
    micros,
    quantiles_ordered,
    stable_id,
)
from stagecast.operators.blocks import before_block, in_block, with_blocks
from stagecast.operators.models import linear_center

RECENT = 6 * HOUR
PRIOR_FAR, PRIOR_MID, PRIOR_NEAR = 75 * MINUTE, 60 * MINUTE, 45 * MINUTE


def issue_state(readings: DataFrame, issues: DataFrame, width: int = 10 * DAY) -> DataFrame:
    """What is known at each ``(gauge_id, issued_at)``.

    The newest reading at or before the issue, the reading about an hour before that one (45 to
    75 minutes, nearest to 60, the earlier on ties), and the first value and the count of the
    last six hours. Readings and issues share a window. Blocks overlap by what a frame looks back;
    the newest reading of earlier blocks is carried over together with its prior value, which is
    worked out in its own block, so the answer does not depend on the blocks.
    """
    obs = readings.where(F.col("value").isNotNull()).select(
        "gauge_id",
        micros(F.col("event_time")).alias("us"),
        F.struct(micros(F.col("event_time")).alias("us"), "value", "payload_hash").alias("o"),
        F.lit(False).alias("issue"),
    )
    asked = issues.select("gauge_id", micros(F.col("issued_at")).alias("us")).distinct().select(
        "gauge_id", "us", F.lit(None).cast(obs.schema["o"].dataType).alias("o"), F.lit(True).alias("issue")
    )
    rows = with_blocks(obs.unionByName(asked), "us", width, before=max(RECENT, PRIOR_FAR)).where(
        F.col("home") | ~F.col("issue")
    )
    w = in_block(["gauge_id"], "us")
    farther = F.last("o", ignorenulls=True).over(w.rangeBetween(-PRIOR_FAR, -PRIOR_MID))
    nearer = F.first("o", ignorenulls=True).over(w.rangeBetween(-PRIOR_MID, -PRIOR_NEAR))
    recent = w.rangeBetween(-RECENT, 0)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    middle = F.col("us") - PRIOR_MID
    prior = (
        F.when(F.col("farther").isNull(), F.col("nearer.value"))
        .when(F.col("nearer").isNull(), F.col("farther.value"))
        .when(
            middle - F.col("farther.us") <= F.col("nearer.us") - middle, F.col("farther.value")
        )
        .otherwise(F.col("nearer.value"))
    )
    known = (
        rows.withColumns({"farther": farther, "nearer": nearer})
        .withColumn(
            "seen",
            F.when(F.col("o").isNotNull() & F.col("home"), F.struct("o.*", prior.alias("prior_value"))),
        )
    )
    asked_at = (
        known.withColumns(
            {
                "latest": F.last("seen", ignorenulls=True).over(upto),
                "recent_first": F.first("o.value", ignorenulls=True).over(recent),
                "recent_count": F.count("o.value").over(recent),
            }
        )
        .where("issue")
        .select("gauge_id", "block", "us", "latest", "recent_first", "recent_count")
    )
    earlier = before_block(
        known.groupBy("gauge_id", "block").agg(F.max("seen").alias("carried")),
        ["gauge_id"],
        lasts=["carried"],
    )
    return asked_at.join(earlier, ["gauge_id", "block"], "left").select(
        F.col("gauge_id").alias("target_id"),
        F.timestamp_micros("us").alias("issued_at"),
        F.timestamp_micros(F.coalesce("latest.us", "carried.us")).alias("newest_observation_at"),
        F.coalesce("latest.value", "carried.value").alias("observed_value"),
        F.coalesce("latest.payload_hash", "carried.payload_hash").alias("observed_hash"),
        F.when(F.col("latest").isNull(), F.col("carried.prior_value"))
        .otherwise(F.col("latest.prior_value"))
        .alias("prior_value"),
        "recent_first",
        "recent_count",
        ((F.col("us") - F.coalesce("latest.us", "carried.us")) / F.lit(float(MINUTE))).alias(
            "observation_age_minutes"
        ),
    ).withColumn("freshness", freshness(F.col("observation_age_minutes")))


def _labels(quantiles: Sequence[float]) -> list[str]:
    return [str(float(q)) for q in quantiles]


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _points(horizons: Sequence[int], labels: Sequence[str], values: Column) -> Column:
    """Points of a forecast from values by horizon and quantile."""
    return F.zip_with(
        _literals(horizons),
        values,
        lambda h, v: F.struct(
            h.alias("horizon_hours"),
            (F.col("issued_at") + F.make_dt_interval(hours=h)).alias("valid_at"),
            F.map_from_arrays(_literals(labels), v).alias("quantiles"),
        ),
    )


def _crossings(horizons: Sequence[int], labels: Sequence[str], maximum: Column) -> Column:
    threshold = F.col("flood_stage_ft")
    low, middle, high = (labels.index(q) for q in ("0.05", "0.5", "0.95"))
    return F.zip_with(
        _literals(horizons),
        maximum,
        lambda h, v: F.struct(
            F.lit("minor").alias("threshold_name"),
            threshold.alias("threshold_ft"),
            h.alias("horizon_hours"),
            (v[middle] >= threshold).alias("median_crosses"),
            ((v[low] < threshold) & (threshold <= v[high])).alias("forecast_interval_straddles"),
        ),
    )


def _document(
    rows: DataFrame,
    version: Column,
    model_status: str,
    discharge_version: str,
    mapping: str,
    horizons: Sequence[int],
    labels: Sequence[str],
    mode: str,
) -> DataFrame:
    """Forecast rows from ``stage_q``, ``maximum_q`` and perhaps ``discharge_q``: values by
    horizon and quantile. Arrays keep the generated code small."""
    snapshot = stable_id(
        F.col("target_id"), iso_utc(F.col("issued_at")), F.col("observed_hash"), F.lit(mode)
    )
    stage = _points(horizons, labels, F.col("stage_q"))
    discharge = (
        _points(horizons, labels, F.col("discharge_q"))
        if "discharge_q" in rows.columns
        else F.filter(stage, lambda p: F.lit(False))
    )
    horizon_models = F.create_map(*[F.lit(x) for h in horizons for x in (h, mapping)])
    return rows.withColumn("snapshot_id", snapshot).select(
        stable_id(F.col("snapshot_id"), version).alias("id"),
        "target_id",
        "issued_at",
        "newest_observation_at",
        "observation_age_minutes",
        F.col("issued_at").alias("available_data_cutoff"),
        "snapshot_id",
        version.alias("stage_model_version"),
        F.lit(model_status).alias("model_status"),
        F.lit(discharge_version).alias("discharge_model_version"),
        F.lit("nwps-live").alias("threshold_version"),
        F.lit(mode).alias("mode"),
        "freshness",
        degradation_reasons(F.col("freshness")).alias("degradation_reasons"),
        stage.alias("stage"),
        _points(horizons, labels, F.col("maximum_q")).alias("maximum_stage"),
        discharge.alias("discharge"),
        _crossings(horizons, labels, F.col("maximum_q")).alias("threshold_crossings"),
        horizon_models.alias("horizon_model_mapping"),
    )


def issuable(state: DataFrame, needs_prior: bool = False) -> DataFrame:
    """Rows fresh enough for a forecast."""
    fresh = state.where(F.col("freshness").isin("supported", "degraded"))
    return fresh.where(F.col("prior_value").isNotNull()) if needs_prior else fresh


def refusals(state: DataFrame, needs_prior: bool = False) -> DataFrame:
    """Rows that get no forecast, and why, as a code; the age of the newest reading stands by it."""
    reason = F.when(F.col("newest_observation_at").isNull(), "no reading").when(
        F.col("freshness") == "suppressed", "too old"
    )
    if needs_prior:
        reason = reason.when(F.col("prior_value").isNull(), "no earlier reading")
    return (
        state.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("target_id", "issued_at", "observation_age_minutes", "reason")
    )


def persistence_forecasts(
    state: DataFrame,
    thresholds: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    mode: str = "direct",
) -> DataFrame:
    """Damped-trend persistence: the latest value plus a fading share of the recent slope.

    The slope is per reading, not per hour. Thresholds are ``(target_id, flood_stage_ft)``.
    """
    readings = F.col("recent_count")
    slope = F.when(readings < 2, 0.0).otherwise(
        (F.col("observed_value") - F.col("recent_first")) / F.greatest(F.lit(1), readings - 1)
    )
    rows = issuable(state).join(thresholds, "target_id").withColumn("slope", slope)
    base = F.col("observed_value")
    offsets = _literals(PERSISTENCE_OFFSETS.values())

    def around(centers: Column, spreads: Column) -> Column:
        return F.zip_with(
            centers, spreads, lambda c, w: F.transform(offsets, lambda z: F.greatest(F.lit(0.0), c + z * w))
        )

    spread = [0.08 + 0.06 * h**0.5 for h in horizons]
    rows = (
        rows.withColumn(
            "centers",
            F.array(*[base + F.col("slope") * 6 * (1 - exp(-h / 6)) for h in horizons]),
        )
        .withColumn(
            "tops",
            F.transform(
                "centers",
                lambda c, i: F.greatest(base, F.array_max(F.slice("centers", F.lit(1), i + 1))),
            ),
        )
        .withColumn(
            "flows",
            F.transform(
                "centers",
                lambda c: F.greatest(F.lit(0.0), 500 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1.5))),
            ),
        )
        .withColumn("flow_spread", F.transform("flows", lambda q: F.greatest(F.lit(25.0), q * 0.15)))
        .withColumn("stage_q", around(F.col("centers"), _literals(spread)))
        .withColumn("maximum_q", around(F.col("tops"), _literals([w * 1.15 for w in spread])))
        .withColumn("discharge_q", around(F.col("flows"), F.col("flow_spread")))
    )
    return _document(
        rows,
        F.lit(PERSISTENCE_MODEL),
        "baseline",
        "separate-rating-proxy-v1",
        "no-nwp",
        horizons,
        _labels(PERSISTENCE_OFFSETS),
        mode,
    )


def ridge_forecasts(
    state: DataFrame,
    models: DataFrame,
    thresholds: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    quantiles: Sequence[float] = QUANTILES,
    mode: str = "direct",
) -> DataFrame:
    """Frozen target-only ridge models with calibrated residual offsets; no discharge.

    Offsets are clipped at zero before the running maximum, which starts at the latest value.
    """
    features = [F.col("observed_value"), F.col("observed_value") - F.col("prior_value")]
    rows = (
        issuable(state, needs_prior=True)
        .join(thresholds, "target_id")
        .join(
            models.select(
                "target_id",
                "feature_means",
                "feature_scales",
                "intercept",
                "weights",
                "residual_quantile_offsets",
            ),
            "target_id",
        )
    )
    labels = _labels(quantiles)
    residuals = F.transform(
        F.sequence(F.lit(0), F.lit(len(horizons) - 1)),
        lambda i: F.transform(
            _literals(labels), lambda q: F.get(F.col("residual_quantile_offsets")[q], i)
        ),
    )
    base = F.col("observed_value")
    rows = (
        rows.withColumn(
            "centers", F.array(*[linear_center(features, i) for i in range(len(horizons))])
        )
        .withColumn("residuals", residuals)
        .withColumn(
            "stage_q",
            F.zip_with(
                "centers", "residuals",
                lambda c, r: F.transform(r, lambda o: F.greatest(F.lit(0.0), c + o)),
            ),
        )
        .withColumn(
            "maximum_q",
            F.transform(
                "stage_q",
                lambda v, i: F.transform(
                    v,
                    lambda s, k: F.greatest(
                        base,
                        F.array_max(
                            F.transform(F.slice("stage_q", F.lit(1), i + 1), lambda w: F.get(w, k))
                        ),
                    ),
                ),
            ),
        )
    )
    return _document(
        rows,
        F.concat(F.lit(f"{RIDGE_MODEL}-"), F.col("target_id")),
        "candidate_shadow",
        "unavailable",
        "no-nwp-target-only",
        horizons,
        labels,
        mode,
    )


def quantile_rows(forecasts: DataFrame, part: str = "stage") -> DataFrame:
    """One row per forecast, horizon and quantile."""
    return (
        forecasts.select("id", "target_id", "issued_at", F.explode(part).alias("p"))
        .select("id", "target_id", "issued_at", "p.horizon_hours", "p.valid_at", F.explode("p.quantiles").alias("q", "value"))
        .withColumn("quantile", F.col("q").cast("double"))
        .drop("q")
    )


def crossing_rows(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("id", "target_id", "issued_at", F.inline("threshold_crossings"))


PARTS = ("stage", "maximum_stage", "discharge")


def _in_order(parts: Sequence[str]) -> Column:
    """Whether quantiles rise at every horizon of every part; a part that is null is in order."""
    each = [F.coalesce(F.forall(part, lambda p: quantiles_ordered(p["quantiles"])), F.lit(True)) for part in parts]
    return reduce(and_, each)


def ordered_only(forecasts: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Forecasts whose quantiles do not cross at any horizon, in any part."""
    return forecasts.where(_in_order(parts))


def crossing_quantiles(forecasts: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Forecasts to reject, all that ``ordered_only`` leaves out: quantiles cross at some horizon."""
    return forecasts.where(~_in_order(parts))
