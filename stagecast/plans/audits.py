"""Audits over all gauges: quality, stage and upstream analysis."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.constants import ARCHIVE_START, DISCHARGE, HOUR, RELEASE_PROXIES, SPLITS, STAGE
from stagecast.functions.columns import month_count
from stagecast.operators import coverage as c
from stagecast.operators import episodes as e
from stagecast.operators import series as s
from stagecast.operators import upstream as u
from stagecast.operators.quantiles import quantile_columns
from stagecast.operators.revisions import BY_TIME, canonical, revision_statistics, scan
from stagecast.session import materialise
from stagecast.sources.payloads import latest_snapshot, threshold_rows


def training_thresholds(samples: DataFrame, training_end: date, keys: Sequence[str] = ("gauge_id",)) -> DataFrame:
    """High-water thresholds: p95 and p99 of the training values, as threshold rows."""
    training = samples.where(F.col("event_time").cast("date") <= F.lit(training_end))
    wide = quantile_columns(
        training, keys, "value", {"training_p95_high_water": 0.95, "training_p99_high_water": 0.99}
    )
    return wide.unpivot(
        list(keys),
        ["training_p95_high_water", "training_p99_high_water"],
        "threshold_name",
        "threshold",
    )


def _end_of(day: date):
    return F.lit(day + timedelta(days=1)).cast("timestamp_ntz")


def quality_audit(
    revisions: DataFrame,
    gauges: DataFrame,
    snapshots: DataFrame | None,
    cutoff: date,
    start: date = ARCHIVE_START,
    splits=SPLITS,
    source: str = "usgs",
    parameter: str = STAGE,
    per_day: int = 96,
    **episode_rule: int,
) -> dict[str, DataFrame]:
    """The detailed audit as tables: samples, coverage, thresholds, episodes, clusters, gates."""
    wanted = scan(revisions, parameter=parameter, source=source, before=_end_of(cutoff)).join(
        gauges.select("gauge_id"), "gauge_id", "left_semi"
    )
    samples = materialise(
        canonical(wanted, BY_TIME).select("gauge_id", "event_time", "value"), "samples"
    )
    monthly = c.monthly_coverage(samples, gauges, start, cutoff, per_day=per_day)
    thresholds = training_thresholds(samples, splits[0][2])
    if snapshots is not None:
        official = threshold_rows(latest_snapshot(snapshots))
        thresholds = official.unionByName(thresholds.select(*official.columns))
    by_threshold = ["gauge_id", "threshold_name"]
    found = materialise(
        e.flood_episodes(samples.join(thresholds, "gauge_id"), keys=by_threshold, **episode_rule),
        "episodes",
    )
    counted = e.episodes_by_split(found, thresholds, cutoff, by_threshold, splits)
    members = materialise(e.storm_cluster_members(found, ["threshold_name"]), "members")
    clusters = e.cluster_bounds(members, ["threshold_name"])
    by_split = e.clusters_by_split(clusters, cutoff, ["threshold_name"], splits)
    gate = e.target_gate(counted, e.pooled_gate(by_split, ["threshold_name"]), ["threshold_name"])
    return {
        "summary": s.value_summary(samples)
        .join(revision_statistics(wanted), "gauge_id")
        .join(s.gap_summary(samples), "gauge_id"),
        "monthly_coverage": monthly,
        "seasonal_coverage": c.seasonal_coverage(monthly),
        "low_months": c.low_months(monthly),
        "thresholds": thresholds,
        "episodes": found,
        "episodes_by_split": counted,
        "uncertain_episodes": found.groupBy(*by_threshold).agg(
            F.count("*").alias("episodes"), F.count_if("uncertain_end").alias("uncertain_episodes")
        ),
        "clusters": clusters,
        "cluster_members": members,
        "clusters_by_split": by_split,
        "gate": gate,
        "gate_status": e.overall_gate(gate, ["threshold_name"]),
    }


def stage_audit(
    revisions: DataFrame,
    gauges: DataFrame,
    cutoff: date,
    start: date = ARCHIVE_START,
    splits=SPLITS,
    source: str = "usgs",
    parameter: str = STAGE,
    per_day: int = 96,
    **episode_rule: int,
) -> dict[str, DataFrame]:
    """Coverage, episodes of the flood stage, clusters and the pooled gate.

    Gauges are ``(gauge_id, flood_stage_ft)``.
    """
    wanted = scan(revisions, parameter=parameter, source=source, before=_end_of(cutoff))
    samples = materialise(
        canonical(wanted.join(gauges, "gauge_id"), BY_TIME).select(
            "gauge_id", "event_time", "value", "flood_stage_ft"
        ),
        "samples",
    )
    name = F.lit("flood_stage").alias("threshold_name")
    found = materialise(
        e.flood_episodes(samples, "flood_stage_ft", **episode_rule).select("*", name), "episodes"
    )
    members = materialise(e.storm_cluster_members(found, ["threshold_name"]), "members")
    clusters = e.cluster_bounds(members, ["threshold_name"])
    by_split = e.clusters_by_split(clusters, cutoff, ["threshold_name"], splits)
    counted = e.episodes_by_split(
        found, gauges.select("*", name), cutoff, ["gauge_id", "threshold_name"], splits
    )
    gate = e.target_gate(counted, e.pooled_gate(by_split))
    cover = c.overall_coverage(samples, start, cutoff, per_day=per_day)
    return {
        "coverage": cover,
        "complete": cover.agg(F.bool_and("complete").alias("complete")),
        "episodes": found,
        "episodes_by_split": counted,
        "clusters": clusters,
        "cluster_members": members,
        "clusters_by_split": by_split,
        "gate": e.overall_gate(gate),
    }


def upstream_analysis(
    revisions: DataFrame,
    links: DataFrame,
    catalogue: DataFrame | None,
    start: date,
    cutoff: date,
    training_end: date = SPLITS[0][2],
    source: str = "usgs",
    target_parameter: str = STAGE,
    upstream_parameter: str = DISCHARGE,
    maximum_lag: int = 72,
    minimum_pairs: int = 1000,
    minimum_coverage: float = 0.8,
) -> dict[str, DataFrame]:
    """Coverage of the linked gauges over the archive and travel lags from training data only.

    Refuses to run while a linked gauge lacks archived months, when a catalogue is given.
    """
    if catalogue is not None:
        required = u.acquisition_list(links, (upstream_parameter,))
        c.require_complete(
            c.incomplete_series(required, c.archived_partitions(catalogue, source), month_count(start, cutoff))
        )

    def series_of(side: str, parameter: str) -> DataFrame:
        ids = links.select(F.col(side).alias("gauge_id")).distinct()
        rows = scan(revisions, parameter=parameter, source=source, before=_end_of(cutoff))
        return canonical(rows.join(ids, "gauge_id", "left_semi"), BY_TIME)

    def training(df: DataFrame) -> DataFrame:
        return df.where(F.col("event_time") < _end_of(training_end))

    flows = series_of("gauge_id", upstream_parameter)
    stages = series_of("target_id", target_parameter)
    sweep = u.lag_sweep(
        s.step_changes(s.step_means(training(flows), step=HOUR), log=True),
        s.step_changes(s.step_means(training(stages), step=HOUR)),
        links.select("target_id", "gauge_id"),
        maximum_lag,
        minimum_pairs,
    )
    expected = ((cutoff - start).days + 1) * 96
    cover = s.quarter_hour_coverage(flows, expected)
    qualified = u.qualify(u.select_lags(sweep), cover, minimum_coverage)
    return {
        "sweep": sweep,
        "coverage": cover,
        "qualified": qualified,
        "enough": u.enough_suitable(qualified),
    }


def upstream_selection(
    topology: DataFrame,
    metadata: DataFrame,
    start: date,
    cutoff: date,
    proxies: dict[str, str] = RELEASE_PROXIES,
    lean: int = 3,
    **rule,
) -> dict[str, DataFrame]:
    """Candidates, selection and lean selection from landed topology and series metadata.

    ``proxies`` name the gauge a target must keep, ``lean`` is the mainstem gauges of the lean
    selection, ``rule`` goes to ``select_candidates``. ``acquisition`` lists each gauge once.
    """
    candidates = u.connected_candidates(topology, u.preferred_series(metadata), start, cutoff)
    selected = u.select_candidates(candidates, proxies=proxies, **rule)
    return {
        "candidates": candidates,
        "ranked": u.rank_candidates(candidates),
        "selected": selected,
        "model_selected": u.lean_selection(selected, lean, proxies),
        "acquisition": u.acquisition_list(selected),
    }
