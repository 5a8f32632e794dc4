"""Episodes, storm clusters, gates, event transitions and window labels."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import DAY, HORIZONS, HOUR
from stagecast.operators import episodes as e
from stagecast.operators.events import event_transitions
from stagecast.operators.labels import window_labels
from stagecast.plans.audits import quality_audit, stage_audit, training_thresholds
from stagecast.queries.bindings import (
    CANON,
    DAILY_CUTOFF,
    DAILY_SPLITS,
    DAILY_SQL,
    DAILY_START,
    OBS,
    daily_samples,
    query,
    rounded,
    samples,
    split_sql,
    table,
)
from stagecast.session import materialise

# the episode rule with days for hours: a step over two days is a gap
RULE = {"gap": 2 * DAY, "quiet_for": 5 * DAY, "merge_within": 15 * DAY, "width": 120 * DAY}
MARGIN = 3 * DAY
THRESHOLD = 29.0


def episode_sql(src: str, keys: str, out: str = "episodes", gap: int = 2 * DAY, quiet: int = 5 * DAY, merge: int = 15 * DAY) -> str:
    """Episodes of CTE ``src`` (keys, us, value, threshold) by windows over whole series."""
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
e1 AS (SELECT *, lag(us) OVER (PARTITION BY {keys} ORDER BY us) AS prev FROM {src}),
e2 AS (SELECT *, coalesce(value >= threshold, false) AS above,
  coalesce(us - prev > {gap}, false) AS gap FROM e1),
e3 AS (SELECT *, NOT above AND value IS NOT NULL AND NOT gap AS quiet FROM e2),
e4 AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY us) AS run
  FROM e3),
e5 AS (SELECT *, quiet AND us - min(us) FILTER (quiet) OVER (PARTITION BY {keys}, run) >= {quiet}
  AS ripe FROM e4),
e6 AS (SELECT *, CASE WHEN ripe AND row_number() OVER (PARTITION BY {keys}, run, ripe ORDER BY us) = 1
  THEN 1 ELSE 0 END AS closes FROM e5),
e7 AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY {keys} ORDER BY us
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM e6),
starts AS (SELECT {keys}, ep, min(us) FILTER (above) AS s, max(us) FILTER (above) AS l,
  max(value) FILTER (above) AS m, max(closes) = 1 AS closed FROM e7 GROUP BY {keys}, ep
  HAVING count(*) FILTER (above) > 0),
flagged AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, a.ep, a.s, a.l, a.m, a.closed,
  NOT a.closed OR EXISTS (SELECT 1 FROM e7 b WHERE {join} AND a.ep = b.ep AND b.us > a.s
    AND (b.gap OR b.value IS NULL)) AS doubt FROM starts a),
chained AS (SELECT *, CASE WHEN s - lag(l) OVER (PARTITION BY {keys}, closed ORDER BY s) < {merge}
  THEN 0 ELSE 1 END AS fresh FROM flagged),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys}, closed ORDER BY s) AS g FROM chained),
{out} AS (SELECT {keys}, make_timestamp(min(s)) AS started_at, make_timestamp(max(l)) AS last_above_at,
  max(m) AS maximum, bool_or(doubt) AS uncertain_end FROM numbered GROUP BY {keys}, closed, g)"""


def cluster_sql(keys: str = "") -> str:
    """Clusters and members of CTE ``episodes``."""
    by = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""
c1 AS (SELECT {k}gauge_id, started_at - INTERVAL 3 DAY AS a, last_above_at + INTERVAL 3 DAY AS b
  FROM episodes),
c2 AS (SELECT *, CASE WHEN a <= max(b) OVER ({by} ORDER BY a, b, gauge_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM c1),
c3 AS (SELECT *, sum(fresh) OVER ({by} ORDER BY a, b, gauge_id
  ROWS UNBOUNDED PRECEDING) AS cluster FROM c2),
clusters AS (SELECT {k}cluster, min(a) AS started_at, max(b) AS ended_at, count(*) AS episode_count,
  string_agg(DISTINCT gauge_id, ',' ORDER BY gauge_id) AS gauges FROM c3 GROUP BY {k}cluster)"""


_SRC = f"""{DAILY_SQL}, src AS (
  SELECT series AS gauge_id, idx * {DAY} AS us, value, {THRESHOLD} AS threshold FROM daily)"""
_EPISODES = f"{_SRC}, {episode_sql('src', 'gauge_id')}"


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return e.flood_episodes(daily_samples(spark, d), F.lit(THRESHOLD), **RULE)


@query(f"""WITH {_EPISODES}
SELECT gauge_id, started_at, last_above_at, round(maximum, 6) AS maximum, uncertain_end FROM episodes""")
def flood_episodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_episodes(spark, d), "maximum")


_NATIVE = f"""{OBS}, {CANON}, src AS (SELECT gauge_id, epoch_us(event_time) AS us, value,
  CAST(250 AS DOUBLE) AS threshold FROM canon)"""


@query(f"""WITH {_NATIVE}, {episode_sql('src', 'gauge_id', gap=3 * HOUR, quiet=6 * HOUR, merge=12 * HOUR)}
SELECT gauge_id, started_at, last_above_at, round(maximum, 6) AS maximum, uncertain_end FROM episodes""")
def native_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes at the native step, nulls included."""
    found = e.flood_episodes(
        samples(spark, d), F.lit(250.0), gap=3 * HOUR, quiet_for=6 * HOUR,
        merge_within=12 * HOUR, width=3 * DAY,
    )
    return rounded(found, "maximum")


_BY_THRESHOLD = f"""{DAILY_SQL},
levels AS (SELECT series, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
  FROM daily WHERE make_timestamp(idx * {DAY}) < TIMESTAMP '1999-01-01' GROUP BY 1),
thresholds AS (SELECT series, 'training_p95_high_water' AS threshold_name, p95 AS threshold FROM levels
  UNION ALL SELECT series, 'training_p99_high_water', p99 FROM levels),
src AS (SELECT d.series AS gauge_id, threshold_name, idx * {DAY} AS us, value, threshold
  FROM daily d JOIN thresholds USING (series)),
{episode_sql('src', 'gauge_id, threshold_name')}"""


def _threshold_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Read more than once by every report, so stored."""
    found = materialise(daily_samples(spark, d), "samples")
    levels = training_thresholds(found, DAILY_SPLITS[0][2])
    return materialise(
        e.flood_episodes(
            found.join(levels, "gauge_id"), keys=["gauge_id", "threshold_name"], **RULE
        ),
        "episodes",
    )


@query(f"""WITH {_BY_THRESHOLD}
SELECT gauge_id, threshold_name, count(*) AS episodes,
  count(*) FILTER (uncertain_end) AS uncertain_episodes, min(started_at) AS first_started,
  max(last_above_at) AS last_above, round(max(maximum), 6) AS maximum
FROM episodes GROUP BY 1, 2""")
def episodes_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = _threshold_episodes(spark, d).groupBy("gauge_id", "threshold_name").agg(
        F.count("*").alias("episodes"),
        F.count_if("uncertain_end").alias("uncertain_episodes"),
        F.min("started_at").alias("first_started"),
        F.max("last_above_at").alias("last_above"),
        F.max("maximum").alias("maximum"),
    )
    return rounded(found, "maximum")


_CLUSTERS = f"{_BY_THRESHOLD}, {cluster_sql('threshold_name')}"


def _clusters(episodes: DataFrame) -> DataFrame:
    return e.storm_clusters(episodes, ["threshold_name"], margin=MARGIN, width=90 * DAY)


@query(f"""WITH {_CLUSTERS}
SELECT threshold_name, started_at, ended_at, gauges, episode_count FROM clusters""")
def storm_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(_threshold_episodes(spark, d)).withColumn("gauges", F.array_join("gauge_ids", ",")).drop("gauge_ids")


@query(f"""WITH {_EPISODES}, {cluster_sql()}
SELECT started_at, ended_at, gauge_id, count(*) AS episode_count
FROM c3 JOIN clusters USING (cluster) GROUP BY 1, 2, 3""")
def storm_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    found = materialise(_episodes(spark, d), "episodes")
    return e.storm_cluster_members(found, margin=MARGIN, width=90 * DAY)


_MIDDLE = "CAST(make_timestamp((epoch_us(started_at) + epoch_us(last_above_at)) // 2) AS DATE)"
_SPLIT_NAMES = "(VALUES ('training'), ('validation'), ('calibration'), ('test')) n(split)"
_COUNTED = f"""
counted AS (SELECT gauge_id, threshold_name, {split_sql(_MIDDLE, DAILY_SPLITS, DAILY_CUTOFF)} AS split,
  count(*) AS episodes FROM episodes GROUP BY 1, 2, 3),
episode_counts AS (SELECT t.series AS gauge_id, t.threshold_name, n.split, coalesce(c.episodes, 0) AS episodes
  FROM thresholds t CROSS JOIN {_SPLIT_NAMES}
  LEFT JOIN counted c ON c.gauge_id = t.series AND c.threshold_name = t.threshold_name
    AND c.split = n.split)"""


def _counted(spark: SparkSession, d: str, episodes: DataFrame) -> DataFrame:
    names = F.explode(F.array(F.lit("training_p95_high_water"), F.lit("training_p99_high_water")))
    gauges = daily_samples(spark, d).select("gauge_id").distinct().withColumn("threshold_name", names)
    return e.episodes_by_split(
        episodes, gauges, DAILY_CUTOFF, ["gauge_id", "threshold_name"], DAILY_SPLITS
    )


@query(f"WITH {_BY_THRESHOLD}, {_COUNTED} SELECT gauge_id, threshold_name, split, episodes FROM episode_counts")
def episodes_by_split(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, _threshold_episodes(spark, d))


def _containing_sql() -> str:
    parts = []
    for name, first, last in DAILY_SPLITS:
        after = (last or DAILY_CUTOFF) + timedelta(days=1)
        parts.append(
            f"WHEN started_at >= TIMESTAMP '{first}' AND ended_at < TIMESTAMP '{after}' THEN '{name}'"
        )
    return "CASE " + " ".join(parts) + " END"


_CLUSTER_COUNTS = f"""
cluster_counts AS (SELECT threshold_name, {_containing_sql()} AS split, count(*) AS clusters
  FROM clusters GROUP BY 1, 2)"""


def _cluster_counts(episodes: DataFrame) -> DataFrame:
    return e.clusters_by_split(_clusters(episodes), DAILY_CUTOFF, ["threshold_name"], DAILY_SPLITS)


@query(f"WITH {_CLUSTERS}, {_CLUSTER_COUNTS} SELECT * FROM cluster_counts")
def clusters_by_split(spark: SparkSession, d: str) -> DataFrame:
    return _cluster_counts(_threshold_episodes(spark, d))


_GATE = f"""{_CLUSTERS}, {_COUNTED}, {_CLUSTER_COUNTS},
pooled AS (SELECT threshold_name,
  coalesce(sum(clusters) FILTER (split = 'training'), 0) >= 30
  AND coalesce(sum(clusters) FILTER (split = 'validation'), 0) >= 10
  AND coalesce(sum(clusters) FILTER (split = 'calibration'), 0) >= 10 AS pooled_gate_passed
  FROM cluster_counts GROUP BY 1),
own AS (SELECT threshold_name, gauge_id,
  sum(episodes) FILTER (split = 'training') >= 3
  AND sum(episodes) FILTER (split = 'calibration') >= 3 AS enough_episodes
  FROM episode_counts GROUP BY 1, 2)"""


@query(f"""WITH {_GATE}
SELECT threshold_name, gauge_id, enough_episodes, pooled_gate_passed,
  coalesce(pooled_gate_passed, false) AND enough_episodes AS eligible
FROM own LEFT JOIN pooled USING (threshold_name)""")
def eligibility_gate(spark: SparkSession, d: str) -> DataFrame:
    found = _threshold_episodes(spark, d)
    pooled = e.pooled_gate(_cluster_counts(found), ["threshold_name"])
    return e.target_gate(_counted(spark, d, found), pooled, ["threshold_name"])


@query(f"""WITH {_GATE}, g AS (SELECT threshold_name,
  coalesce(pooled_gate_passed, false) AND enough_episodes AS eligible
  FROM own LEFT JOIN pooled USING (threshold_name))
SELECT threshold_name, bool_and(eligible) AS eligible, count(*) FILTER (eligible) AS eligible_targets,
  CASE WHEN bool_or(eligible) THEN 'eligible_for_calibration_experiment'
    ELSE 'insufficient_events' END AS status
FROM g GROUP BY 1""")
def eligibility_status(spark: SparkSession, d: str) -> DataFrame:
    return e.overall_gate(eligibility_gate(spark, d), ["threshold_name"])


_READINGS = """r AS (
  SELECT event_type AS gauge_id, event_id AS seq, ts AS tm, strftime(ts, '%Y-%m-%d %H') AS batch_id,
         value >= 60 AS above, value < 1 AS stale FROM events)"""


def event_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings for event confirmation: a batch per hour, threshold 60, stale under 1."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("gauge_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("batch_id"),
        F.col("value").alias("stage"),
        F.lit(60.0).alias("threshold"),
        (F.col("value") < 1).alias("stale"),
    )


EVENT_SQL = f"""WITH {_READINGS},
f AS (SELECT *, sum(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY gauge_id ORDER BY seq) AS island
  FROM r WHERE NOT stale),
b AS (SELECT gauge_id, island, batch_id, min(seq) AS seq FROM f WHERE NOT above GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY gauge_id, island ORDER BY seq) AS k FROM b),
closed AS (SELECT gauge_id, island, seq FROM n WHERE k = 3 AND island > 0),
opened AS (SELECT f.gauge_id, f.seq FROM f WHERE above AND (island = 1 OR EXISTS (
  SELECT 1 FROM closed c WHERE c.gauge_id = f.gauge_id AND c.island = f.island - 1)))
SELECT t.gauge_id, t.seq, r.tm AS event_time, t.transition FROM (
  SELECT gauge_id, seq, 'observed_flooding' AS transition FROM opened
  UNION ALL SELECT gauge_id, seq, 'resolved' FROM closed
  UNION ALL SELECT gauge_id, seq, 'unknown_stale' FROM r WHERE stale) t
JOIN r ON r.gauge_id = t.gauge_id AND r.seq = t.seq"""


@query(EVENT_SQL)
def event_confirmation(spark: SparkSession, d: str) -> DataFrame:
    return event_transitions(event_readings(spark, d), width=1000).withColumnRenamed("at", "event_time")


_LABELS = " UNION ALL ".join(
    f"""SELECT i.gauge_id, i.issued_at, 200.0 AS threshold, {h} AS horizon_hours, max(o.value) AS maximum,
  count(o.value) AS valid_samples,
  CASE WHEN max(o.value) >= 200 THEN true WHEN count(o.value) >= {h * HOUR // (4 * HOUR)} THEN false END AS crossed
FROM issues i LEFT JOIN nn o ON o.gauge_id = i.gauge_id AND o.event_time > i.issued_at
  AND o.event_time <= i.issued_at + INTERVAL {h} HOUR GROUP BY 1, 2"""
    for h in HORIZONS
)


def label_issues(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "event_time").cast("timestamp_ntz")
    return samples(spark, d).select(
        "gauge_id", (hour + F.expr("interval 20 minutes")).alias("issued_at"), F.lit(200.0).alias("threshold")
    ).distinct()


@query(f"""WITH {OBS}, {CANON}, nn AS (SELECT * FROM canon WHERE value IS NOT NULL),
issues AS (SELECT DISTINCT gauge_id, date_trunc('hour', event_time) + INTERVAL 20 MINUTE AS issued_at
  FROM canon)
SELECT gauge_id, issued_at, CAST(threshold AS DOUBLE) AS threshold, horizon_hours, maximum,
  valid_samples, crossed FROM ({_LABELS})""")
def window_labels_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Labels where a reading per hour counts as full coverage of up to a day and more."""
    return window_labels(samples(spark, d), label_issues(spark, d), interval=4 * HOUR, width=5 * DAY)


_AUDIT = f"""{_BY_THRESHOLD},
{cluster_sql('threshold_name')}, {_COUNTED}, {_CLUSTER_COUNTS}, {_GATE.split(_CLUSTER_COUNTS)[1].lstrip(", ")}"""


@query(f"""WITH {_AUDIT}, u AS (SELECT gauge_id, threshold_name, count(*) AS episodes,
  count(*) FILTER (uncertain_end) AS uncertain_episodes FROM episodes GROUP BY 1, 2)
SELECT threshold_name, gauge_id, enough_episodes, pooled_gate_passed,
  coalesce(pooled_gate_passed, false) AND enough_episodes AS eligible, episodes, uncertain_episodes
FROM own LEFT JOIN pooled USING (threshold_name) LEFT JOIN u USING (gauge_id, threshold_name)""")
def quality_audit_gates(spark: SparkSession, d: str) -> DataFrame:
    """The whole quality audit over daily gauges, ending in its gate."""
    rows = _as_revisions(spark, d)
    report = quality_audit(
        rows, rows.select("gauge_id").distinct(), None, DAILY_CUTOFF, DAILY_START, DAILY_SPLITS,
        source="lineitem", per_day=1, **RULE,
    )
    return report["gate"].join(
        report["uncertain_episodes"], ["gauge_id", "threshold_name"], "left"
    )


@query(f"""WITH {_EPISODES}, c AS (SELECT gauge_id, count(*) AS samples, make_timestamp(min(us)) AS first_observation,
  make_timestamp(max(us)) AS last_observation FROM src GROUP BY 1),
k AS (SELECT gauge_id, {split_sql(_MIDDLE, DAILY_SPLITS, DAILY_CUTOFF)} AS split, count(*) AS episodes
  FROM episodes GROUP BY 1, 2)
SELECT c.*, CAST(2557 AS BIGINT) AS expected_samples, round(samples / 2557.0, 6) AS coverage_fraction,
  samples / 2557.0 >= 0.9 AS complete, n.split, coalesce(k.episodes, 0) AS episodes
FROM c CROSS JOIN {_SPLIT_NAMES} LEFT JOIN k ON k.gauge_id = c.gauge_id AND k.split = n.split""")
def stage_audit_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The stage audit over daily gauges: coverage and episode counts."""
    rows = _as_revisions(spark, d)
    gauges = rows.select("gauge_id", F.lit(THRESHOLD).alias("flood_stage_ft")).distinct()
    report = stage_audit(
        rows, gauges, DAILY_CUTOFF, DAILY_START, DAILY_SPLITS, source="lineitem", per_day=1, **RULE
    )
    return rounded(
        report["coverage"].join(report["episodes_by_split"].drop("threshold_name"), "gauge_id"), "coverage_fraction"
    )


@query(f"""WITH {_AUDIT}
SELECT c3.threshold_name, started_at, ended_at, count(DISTINCT gauge_id) AS gauge_count, count(*) AS episode_count
FROM c3 JOIN clusters k ON k.threshold_name = c3.threshold_name AND k.cluster = c3.cluster GROUP BY 1, 2, 3""")
def quality_audit_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The quality audit's clusters by threshold: bounds and counts, no list of gauges."""
    rows = _as_revisions(spark, d)
    report = quality_audit(
        rows, rows.select("gauge_id").distinct(), None, DAILY_CUTOFF, DAILY_START, DAILY_SPLITS,
        source="lineitem", per_day=1, **RULE,
    )
    return report["clusters"]


@query(f"""WITH {_EPISODES}, {cluster_sql()}
SELECT started_at, ended_at, count(DISTINCT gauge_id) AS gauge_count, count(*) AS episode_count
FROM c3 JOIN (SELECT cluster, started_at, ended_at FROM clusters) k USING (cluster) GROUP BY 1, 2""")
def stage_audit_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The stage audit's clusters: bounds and counts, no list of gauges."""
    rows = _as_revisions(spark, d)
    gauges = rows.select("gauge_id", F.lit(THRESHOLD).alias("flood_stage_ft")).distinct()
    report = stage_audit(
        rows, gauges, DAILY_CUTOFF, DAILY_START, DAILY_SPLITS, source="lineitem", per_day=1, **RULE
    )
    return report["clusters"].drop("threshold_name")


def _as_revisions(spark: SparkSession, d: str) -> DataFrame:
    return daily_samples(spark, d).select(
        "gauge_id",
        F.lit("00065").alias("parameter_code"),
        F.lit("lineitem").alias("source"),
        F.col("gauge_id").alias("time_series_id"),
        "event_time",
        "value",
        F.col("event_time").alias("ingested_at"),
        F.sha2(F.concat_ws("|", "gauge_id", "event_time"), 256).alias("payload_hash"),
    )
