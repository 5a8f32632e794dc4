"""Comparisons with official runs, event scores, probabilities and the bootstrap."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import DAY, HORIZONS, HOUR, MINUTE
from stagecast.functions.columns import from_micros
from stagecast.operators import comparison as c
from stagecast.operators import episodes as e
from stagecast.operators import forecast as f
from stagecast.operators import models as m
from stagecast.operators import verification as v
from stagecast.operators.labels import window_labels
from stagecast.operators.triggers import risk_events
from stagecast.queries.bindings import HOURLY_SQL, hourly, query, rounded, samples
from stagecast.queries.episodes import MARGIN, THRESHOLD, _episodes, cluster_sql, episode_sql
from stagecast.queries.modelling import _FIT, _PERSISTENCE, FEATURES, LABELS, _persistence, _split, forecast_issues, stored_examples
from stagecast.session import materialise

LAG = 100 * MINUTE


def _own(issued: DataFrame) -> DataFrame:
    """Medians of issued forecasts, a point per horizon."""
    rows = f.quantile_rows(issued).where("quantile = 0.5")
    return rows.select("target_id", "issued_at", "horizon_hours", "valid_at", "value")


def _official(issued: DataFrame) -> DataFrame:
    """Official runs that stand in: every six hours the newest reading, rising, a point each six hours.

    Runs of every twelfth hour begin three hours ahead, lack a point and become available late;
    those of every seventh day have no creation time.
    """
    hour, day = F.hour("issued_at"), F.dayofmonth("issued_at")
    base = issued.where(hour % 6 == 0).select("target_id", "issued_at", F.element_at("stage", 1).alias("p"))
    base = base.withColumn("v", F.col("p.quantiles")["0.5"]).withColumn("late", F.hour("issued_at") % 12 == 0)
    steps = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(12)))).where(~(F.col("late") & (F.col("j") == 4)))
    ahead = F.col("j") * 6 + F.when(F.col("late"), 3).otherwise(6)
    return steps.select(
        "target_id",
        F.concat(F.lit("R"), F.date_format("issued_at", "yyyyMMddHH")).alias("run_id"),
        F.when(day % 7 != 0, F.col("issued_at")).alias("created_at"),
        F.when(F.col("late"), F.col("issued_at") + F.expr("interval 500 minutes")).alias("available_at"),
        (F.col("issued_at") + F.make_dt_interval(hours=ahead)).alias("valid_at"),
        (F.col("v") + F.lit(0.1) * (F.col("j") + 1)).alias("value"),
    )


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """The hourly mean, five minutes into its hour, where the valid times lie."""
    at = F.timestamp_micros(F.col("idx") * HOUR + 5 * MINUTE)
    return hourly(spark, d).select(F.col("series").alias("target_id"), at.alias("valid_at"), "value")


_RUNS = f"""{_PERSISTENCE}, {HOURLY_SQL},
own AS (SELECT target_id, issued_at, h, issued_at + to_hours(h) AS valid_at, stage AS value FROM qs WHERE q = 0.5),
truth AS (SELECT series AS target_id, make_timestamp(idx * {HOUR} + {5 * MINUTE}) AS valid_at, value AS observed FROM hourly),
runs AS (SELECT target_id, issued_at, 'R' || strftime(issued_at, '%Y%m%d%H') AS run_id, value AS v,
  extract(hour FROM issued_at) % 12 = 0 AS late FROM own
  WHERE h = {HORIZONS[0]} AND extract(hour FROM issued_at) % 6 = 0 AND extract(day FROM issued_at) % 7 <> 0),
points AS (SELECT target_id, run_id, issued_at AS created_at,
  CASE WHEN late THEN issued_at + INTERVAL 500 MINUTE ELSE issued_at + INTERVAL 100 MINUTE END AS available_at,
  issued_at + to_hours(CAST(j * 6 + CASE WHEN late THEN 3 ELSE 6 END AS INTEGER)) AS valid_at,
  v + CAST(0.1 AS DOUBLE) * (j + 1) AS value
  FROM runs, range(13) r(j) WHERE NOT (late AND j = 4))"""


def _between(b: str, a: str, at: str) -> str:
    """Value at a time from the points on both sides, and how it was found."""
    part = f"((epoch_us({at}) - epoch_us({b}.valid_at)) / (epoch_us({a}.valid_at) - epoch_us({b}.valid_at)))"
    return f"""CASE WHEN {b}.valid_at = {at} THEN {b}.value ELSE {b}.value + ({a}.value - {b}.value) * {part} END AS found,
  CASE WHEN {b}.valid_at = {at} THEN 'exact' WHEN {b}.valid_at IS NOT NULL AND {a}.valid_at IS NOT NULL THEN 'interpolated' END AS how"""


_ALIGNED = f"""{_RUNS}, aligned AS (SELECT p.target_id, p.run_id, p.created_at, p.valid_at, p.value AS official,
  {_between("b", "a", "p.valid_at")}
  FROM (SELECT * FROM points WHERE valid_at <= created_at + INTERVAL 72 HOUR) p
  ASOF LEFT JOIN own b ON b.target_id = p.target_id AND b.issued_at = p.created_at AND p.valid_at >= b.valid_at
  ASOF LEFT JOIN own a ON a.target_id = p.target_id AND a.issued_at = p.created_at AND p.valid_at <= a.valid_at),
rows AS (SELECT l.* RENAME (found AS own), observed FROM aligned l LEFT JOIN truth USING (target_id, valid_at))"""

_OPERATIONAL = f"""{_RUNS}, issued AS (SELECT DISTINCT target_id, issued_at FROM own),
newest AS (SELECT i.target_id, i.issued_at, arg_max(p.run_id, p.created_at) AS run_id, max(p.created_at) AS created_at
  FROM issued i LEFT JOIN points p ON p.target_id = i.target_id AND p.available_at <= i.issued_at GROUP BY 1, 2),
asks AS (SELECT n.*, o.h AS horizon_hours, o.valid_at, o.value AS own FROM newest n JOIN own o USING (target_id, issued_at)),
found AS (SELECT k.*, {_between("b", "a", "k.valid_at")} FROM asks k
  ASOF LEFT JOIN points b ON b.target_id = k.target_id AND b.run_id = k.run_id AND k.valid_at >= b.valid_at
  ASOF LEFT JOIN points a ON a.target_id = k.target_id AND a.run_id = k.run_id AND k.valid_at <= a.valid_at),
rows AS (SELECT l.* RENAME (found AS official), observed,
  (epoch_us(issued_at) - epoch_us(created_at)) / CAST({HOUR} AS DOUBLE) AS age_hours
  FROM found l LEFT JOIN truth USING (target_id, valid_at))"""


def _skill_sql(by: str) -> str:
    both = "own IS NOT NULL AND official IS NOT NULL AND observed IS NOT NULL"
    return f"""SELECT {by}, count(*) AS asked, count(*) FILTER ({both}) AS matched,
  count(*) FILTER ({both} AND how = 'interpolated') AS interpolated,
  round(avg(abs(own - observed)) FILTER ({both}), 6) AS own_mae,
  round(avg(abs(official - observed)) FILTER ({both}), 6) AS official_mae FROM rows GROUP BY {by}"""


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    issued = materialise(_persistence(spark, d).select("id", "target_id", "issued_at", "stage"), "issued")
    return _own(issued), _official(issued), _truth(spark, d)


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return c.creation_aligned(*_inputs(spark, d))


def _operational(spark: SparkSession, d: str) -> DataFrame:
    return c.operational(*_inputs(spark, d), lag=LAG, width=3 * DAY)


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


_SHOWN = ", ".join(f"round({n}, 4) AS {n}" for n in ("own", "official", "observed"))


@query(f"WITH {_ALIGNED} SELECT target_id, run_id, created_at, valid_at, how, {_SHOWN} FROM rows")
def creation_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Official points next to own ones interpolated at their valid times, run by run."""
    found = _ntz(_aligned(spark, d), "created_at", "valid_at")
    return rounded(found, "own", "official", "observed", digits=4)


@query(f"WITH {_ALIGNED} {_skill_sql('target_id')}")
def creation_aligned_skill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.skill(_aligned(spark, d), ["target_id"]), "own_mae", "official_mae")


@query(f"""WITH {_OPERATIONAL} SELECT target_id, issued_at, horizon_hours, valid_at, run_id, created_at,
  round(age_hours, 4) AS age_hours, how, {_SHOWN} FROM rows""")
def operational_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Per issue and horizon the newest official run that was available then."""
    found = _ntz(_operational(spark, d), "issued_at", "valid_at", "created_at")
    return rounded(found, "own", "official", "observed", "age_hours", digits=4)


@query(f"WITH {_OPERATIONAL} {_skill_sql('target_id, horizon_hours')}")
def operational_skill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.skill(_operational(spark, d), ["target_id", "horizon_hours"]), "own_mae", "official_mae")


HIGH, WARN_HOURS = 250.0, 24
_HIGH_RULE = {"gap": 3 * HOUR, "quiet_for": 6 * HOUR, "merge_within": 12 * HOUR, "width": 3 * DAY}


def _warnings(issued: DataFrame) -> DataFrame:
    """The coming day of every forecast whose median maximum of that day is high."""
    day = F.get(F.filter("maximum_stage", lambda p: p["horizon_hours"] == WARN_HOURS), F.lit(0))
    return issued.where(day["quantiles"]["0.5"] >= HIGH).select(
        "target_id", "issued_at", F.col("issued_at").alias("from_at"), day["valid_at"].alias("to_at")
    )


_HIGH = f"""{_PERSISTENCE}, src AS (SELECT gauge_id, epoch_us(event_time) AS us, value, CAST({HIGH} AS DOUBLE) AS threshold FROM canon),
{episode_sql('src', 'gauge_id', gap=3 * HOUR, quiet=6 * HOUR, merge=12 * HOUR)},
warn AS (SELECT target_id, issued_at, issued_at + to_hours({WARN_HOURS}) AS to_at FROM qs
  WHERE q = 0.5 AND h = {WARN_HOURS} AND maximum >= {HIGH}),
matched AS (SELECT w.target_id, w.issued_at, p.started_at FROM warn w JOIN episodes p
  ON p.gauge_id = w.target_id AND w.issued_at <= p.last_above_at AND p.started_at <= w.to_at),
firsts AS (SELECT target_id, started_at, min(issued_at) AS first FROM matched GROUP BY 1, 2),
per AS (SELECT target_id, count(*) FILTER (first < started_at) AS hits, count(*) FILTER (first >= started_at) AS late,
  avg((epoch_us(started_at) - epoch_us(first)) / CAST({HOUR} AS DOUBLE)) FILTER (first < started_at) AS mean_lead,
  max((epoch_us(started_at) - epoch_us(first)) / CAST({HOUR} AS DOUBLE)) FILTER (first < started_at) AS longest
  FROM firsts GROUP BY 1),
useful AS (SELECT target_id, count(DISTINCT issued_at) AS useful FROM matched GROUP BY 1),
ec AS (SELECT gauge_id AS target_id, count(*) AS episodes FROM episodes GROUP BY 1),
wc AS (SELECT target_id, count(*) AS warnings FROM warn GROUP BY 1),
counts AS (SELECT target_id, coalesce(episodes, 0) AS episodes, coalesce(warnings, 0) AS warnings, coalesce(hits, 0) AS hits,
  coalesce(late, 0) AS late, coalesce(useful, 0) AS useful, mean_lead, longest
  FROM ec FULL JOIN wc USING (target_id) LEFT JOIN per USING (target_id) LEFT JOIN useful USING (target_id))"""


@query(f"""WITH {_HIGH} SELECT target_id, episodes, hits, late, episodes - hits - late AS missed,
  round(hits / nullif(episodes, 0), 6) AS recall, warnings, warnings - useful AS false_alarms,
  round((warnings - useful) / nullif(warnings, 0), 6) AS false_alarm_ratio, round(mean_lead, 6) AS mean_lead_hours,
  round(longest, 6) AS longest_lead_hours FROM counts""")
def event_verification(spark: SparkSession, d: str) -> DataFrame:
    """Warnings for the coming day against the episodes that came."""
    episodes = e.flood_episodes(samples(spark, d), F.lit(HIGH), **_HIGH_RULE).withColumnRenamed("gauge_id", "target_id")
    episodes = episodes.withColumns({n: F.col(n).cast("timestamp") for n in ("started_at", "last_above_at")})
    found = v.event_scores(
        materialise(_warnings(_persistence(spark, d)), "warnings"), materialise(episodes, "episodes")
    )
    return rounded(found, "recall", "false_alarm_ratio", "mean_lead_hours", "longest_lead_hours")


RISK = 200.0
_SCORED = f"""{_PERSISTENCE}, outcome AS (SELECT i.gauge_id AS target_id, i.issued_at, CASE WHEN max(o.value) >= {RISK} THEN 1
  WHEN count(o.value) >= 24 THEN 0 END AS y
  FROM issues i LEFT JOIN nn o ON o.gauge_id = i.gauge_id AND o.event_time > i.issued_at
    AND o.event_time <= i.issued_at + INTERVAL 24 HOUR GROUP BY 1, 2),
sides AS (SELECT target_id, issued_at, max(q) FILTER (maximum < {RISK}) AS lq, arg_max(maximum, q) FILTER (maximum < {RISK}) AS lv,
  min(q) FILTER (maximum >= {RISK}) AS hq, arg_min(maximum, q) FILTER (maximum >= {RISK}) AS hv
  FROM qs WHERE h = 24 GROUP BY 1, 2),
scored AS (SELECT target_id, issued_at, 1.0 - CASE WHEN lq IS NULL THEN hq WHEN hq IS NULL THEN lq
  ELSE lq + (hq - lq) * ((CAST({RISK} AS DOUBLE) - lv) / (hv - lv)) END AS p, y FROM sides JOIN outcome USING (target_id, issued_at)
  WHERE y IS NOT NULL)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The probability that the next day reaches a stage, and whether it did."""
    readings = materialise(samples(spark, d).select("gauge_id", "event_time", "value"), "samples")
    issues = forecast_issues(readings).withColumn("threshold", F.lit(RISK))
    labels = window_labels(readings, issues, (24,), interval=HOUR, width=5 * DAY).select(
        F.col("gauge_id").alias("target_id"), F.col("issued_at").cast("timestamp").alias("issued_at"),
        F.col("crossed").alias("happened"),
    )
    day = F.get(F.filter("maximum_stage", lambda p: p["horizon_hours"] == 24), F.lit(0))
    issued = _persistence(spark, d).select("target_id", "issued_at", day["quantiles"].alias("quantiles"))
    rows = issued.join(labels, ["target_id", "issued_at"])
    return rows.withColumn("p", v.exceedance(F.col("quantiles"), F.lit(RISK)))


@query(f"""WITH {_SCORED}, s AS (SELECT target_id, count(*) AS n, avg(y) AS base_rate, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY 1)
SELECT target_id, n, round(base_rate, 6) AS base_rate, round(brier, 6) AS brier,
  round(base_rate * (1 - base_rate), 6) AS brier_climatology, round(base_rate, 6) AS brier_never,
  round(CASE WHEN base_rate * (1 - base_rate) > 0 THEN 1 - brier / (base_rate * (1 - base_rate)) END, 6) AS skill FROM s""")
def risk_brier(spark: SparkSession, d: str) -> DataFrame:
    found = v.brier_scores(_scored(spark, d), ["target_id"])
    return rounded(found, "base_rate", "brier", "brier_climatology", "brier_never", "skill")


@query(f"""WITH {_SCORED} SELECT target_id, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p,
  round(avg(y), 6) AS observed_share FROM scored GROUP BY 1, 2""")
def risk_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(v.reliability(_scored(spark, d), ["target_id"]), "mean_p", "observed_share")


@query(f"""WITH {_SCORED.replace(str(RISK), str(60.0))}, r AS (SELECT target_id, issued_at, 1.0 - CASE WHEN lq IS NULL THEN hq
    WHEN hq IS NULL THEN lq ELSE lq + (hq - lq) * ((CAST(60 AS DOUBLE) - lv) / (hv - lv)) END >= 0.5 AS above FROM sides),
m AS (SELECT *, CASE WHEN above AND lag(above) OVER w THEN 1
  WHEN NOT above AND NOT lag(above) OVER w AND NOT lag(above, 2) OVER w THEN 0 END AS mark
  FROM r WINDOW w AS (PARTITION BY target_id ORDER BY issued_at)),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY issued_at
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM m)
SELECT target_id, issued_at, CASE mark WHEN 1 THEN 'risk_opened' ELSE 'risk_closed' END AS transition FROM s WHERE mark <> was""")
def risk_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Risk events over the issued probabilities: two above to open, three below to close."""
    day = F.get(F.filter("maximum_stage", lambda p: p["horizon_hours"] == 24), F.lit(0))
    p = v.exceedance(day["quantiles"], F.lit(60.0))
    issued = materialise(_persistence(spark, d).select("target_id", "issued_at", p.alias("p")), "issued")
    return _ntz(risk_events(issued, F.col("p") >= 0.5, width=200), "issued_at")


REPLICATES = 200
_CDF = "[" + ", ".join(f"CAST({total!r} AS DOUBLE)" for total in accumulate(exp(-1.0) / factorial(k) for k in range(14))) + "]"
_BOOT = f"""{_FIT}, src AS (SELECT series AS gauge_id, idx * {DAY} AS us, value, {THRESHOLD} AS threshold FROM daily),
{episode_sql('src', 'gauge_id')}, {cluster_sql()},
err AS (SELECT h AS horizon_hours, idx * {DAY} AS us, abs(p - y) AS candidate, abs(x1 - y) AS champion
  FROM scored WHERE split = 'validation'),
placed AS (SELECT e.*, coalesce('storm ' || epoch_us(k.started_at), 'calendar ' || (us // {14 * DAY})) AS block
  FROM err e LEFT JOIN clusters k ON e.us BETWEEN epoch_us(k.started_at) AND epoch_us(k.ended_at)),
sums AS (SELECT horizon_hours, block, CAST(sum(CAST(round((candidate - champion) * 1048576) AS BIGINT)) AS BIGINT) AS d,
  CAST(sum(CAST(round(champion * 1048576) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM placed GROUP BY 1, 2),
drawn AS (SELECT s.*, replicate, (CAST('0x' || substr(sha256('storms|' || block || '|' || replicate), 1, 8) AS BIGINT) + 0.5)
  / CAST(4294967296 AS DOUBLE) AS u FROM sums s, range(1, {REPLICATES + 1}) r(replicate)),
weighed AS (SELECT *, len(list_filter({_CDF}, lambda t: u > t)) AS w FROM drawn),
each AS (SELECT horizon_hours, replicate, CAST(sum(w * d) AS DOUBLE) / 1048576 / nullif(sum(w * n), 0) AS delta FROM weighed GROUP BY 1, 2),
bound AS (SELECT horizon_hours, quantile_disc(delta, 0.95) AS upper FROM each GROUP BY 1),
plain AS (SELECT horizon_hours, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(c) AS DOUBLE) / 1048576 / sum(n) AS champion_mae,
  CAST(sum(d) AS DOUBLE) / 1048576 / sum(n) AS difference FROM sums GROUP BY 1)"""


@query(f"""WITH {_BOOT} SELECT horizon_hours, blocks, pairs, round(champion_mae, 6) AS champion_mae, round(difference, 6) AS difference,
  round(upper, 6) AS upper, round(greatest(0.01, champion_mae * 0.01), 6) AS allowed,
  upper <= greatest(0.01, champion_mae * 0.01) AS non_inferior FROM plain JOIN bound USING (horizon_hours)""")
def storm_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Ridge against persistence on the validation year, resampled by storms."""
    examples = stored_examples(spark, d)
    model = m.fit_ridge(_split(examples, "training"), FEATURES)
    scored = m.predict(_split(examples, "validation"), model, FEATURES)
    pairs = F.inline(
        F.array(*[
            F.struct(
                F.lit(h).alias("horizon_hours"),
                F.abs(F.col(f"p_{h}") - F.col(label)).alias("candidate"),
                F.abs(F.col(FEATURES[0]) - F.col(label)).alias("champion"),
            )
            for h, label in zip(HORIZONS, LABELS)
        ])
    )
    errors = scored.select(from_micros(F.col("idx") * DAY).alias("issued_at"), pairs)
    clusters = e.storm_clusters(materialise(_episodes(spark, d), "episodes"), margin=MARGIN, width=90 * DAY)
    found = v.paired_bootstrap(
        v.storm_blocks(errors, clusters), replicates=REPLICATES, seed="storms"
    )
    return rounded(found, "champion_mae", "difference", "upper", "allowed")
