"""Live cycles at one issue time, over a store that holds stage and discharge."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import DISCHARGE, HOUR
from stagecast.plans.shadow import challenger_inputs, shadow_cycle
from stagecast.queries.bindings import CANON, HOURLY_SQL, POOLED_OBS, observations, query
from stagecast.queries.modelling import _RIDGE, _quantile_table, _thresholds, hourly_models
from stagecast.session import materialise

ISSUED = datetime(2024, 1, 25, 12, 30)
_HOUR = int(datetime(2024, 1, 25, 12, tzinfo=UTC).timestamp()) * 1_000_000 // HOUR


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Stage revisions of the pooled gauge, and as many of discharge."""
    stage = observations(spark, d, "ALL")
    flow = stage.withColumn("parameter_code", F.lit(DISCHARGE)).withColumn("value", F.col("value") * 100 + 7)
    return stage.unionByName(flow)


@query(f"""WITH {POOLED_OBS}, {CANON}, {HOURLY_SQL},
steps AS (SELECT series, unnest(range({_HOUR} - lookback, {_HOUR})) AS idx, lookback
  FROM (SELECT DISTINCT series FROM hourly) JOIN (VALUES (24), (168), (1000)) l(lookback) ON true),
found AS (SELECT s.*, h.value FROM steps s LEFT JOIN hourly h USING (series, idx))
SELECT series AS target_id, lookback, CASE WHEN count(value) = count(*) THEN
  array_to_string(list(round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) ORDER BY idx), ',') END AS history,
  CASE WHEN count(value) < count(*) THEN 'incomplete history' END AS reason
FROM found GROUP BY 1, 2""")
def challenger_histories(spark: SparkSession, d: str) -> DataFrame:
    """Histories of several lengths up to the issue, and the refusal where hours are missing."""
    rows, found = stored(spark, d), None
    targets = rows.select(F.col("gauge_id").alias("target_id")).distinct()
    shown = F.transform("history", lambda v: F.round(v.cast("double"), 3).cast("string"))
    for lookback in (24, 168, 1000):
        got = challenger_inputs(rows, targets, ISSUED, lookback)
        none = F.lit(None).cast("string")
        both = got["histories"].select(
            F.col("series").alias("target_id"), F.array_join(shown, ",").alias("history"), none.alias("reason")
        ).unionByName(got["failures"].select("target_id", none.alias("history"), "reason"))
        both = both.withColumn("lookback", F.lit(lookback))
        found = both if found is None else found.unionByName(both)
    return found


CYCLES = (ISSUED - timedelta(hours=1), ISSUED)
_ISSUE_TIMES = ", ".join(f"(TIMESTAMP '{at}')" for at in CYCLES)


def _at_cycles(sql: str) -> str:
    """SQL over the state at every event gauge's issue times, of the readings a cycle looks at."""
    every = "issues AS (SELECT DISTINCT gauge_id, date_trunc('hour', event_time) + INTERVAL 125 MINUTE AS issued_at FROM canon)"
    fixed = f"issues AS (SELECT DISTINCT gauge_id, issued_at FROM canon, (VALUES {_ISSUE_TIMES}) c(issued_at))"
    prior = "AND l.event_time - INTERVAL 45 MINUTE"
    assert every in sql and prior in sql
    return sql.replace(every, fixed).replace(prior, prior + " AND p.event_time >= l.issued_at - INTERVAL 3 HOUR")


def _cycles(spark: SparkSession, d: str) -> list[dict[str, DataFrame]]:
    """A shadow cycle an hour before the issue, stored, and the one that follows it."""
    rows, basins = observations(spark, d), _thresholds(spark, d)
    models, stored, found = materialise(hourly_models(spark, d), "models"), None, []
    for at in CYCLES:
        cycle = shadow_cycle(rows, models, basins, stored, at, source="events")
        stored = materialise(cycle["forecasts"], "forecasts")
        found.append({**cycle, "forecasts": stored})
    return found


@query(f"""WITH {_at_cycles(_RIDGE)} SELECT id, target_id, issued_at, h AS horizon_hours, probability AS quantile,
  round(stage, 4) AS stage, round(greatest(value, max(stage) OVER (
    PARTITION BY id, probability ORDER BY h)), 4) AS maximum_stage FROM pts""")
def shadow_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """What two shadow cycles leave in the table of forecasts."""
    return _quantile_table(_cycles(spark, d)[-1]["forecasts"], ("stage", "maximum_stage"))


@query(f"""WITH {_at_cycles(_RIDGE)} SELECT target_id, issued_at, id, event_time AS newest_observation_at, freshness,
  CAST(NULL AS VARCHAR) AS reason FROM base JOIN (SELECT DISTINCT target_id FROM fit) USING (target_id)
UNION ALL SELECT target_id, issued_at, NULL, NULL, NULL, CASE
  WHEN event_time IS NULL OR event_time < issued_at - INTERVAL 3 HOUR THEN 'no reading'
  WHEN freshness = 'suppressed' THEN 'too old' ELSE 'no earlier reading' END
FROM state WHERE event_time IS NULL OR freshness = 'suppressed' OR prior_value IS NULL""")
def shadow_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of two shadow cycles the forecasts issued and the targets refused."""
    rows = None
    for at, cycle in zip(CYCLES, _cycles(spark, d)):
        time = F.lit(at).cast("timestamp_ntz").alias("issued_at")
        newest = F.col("newest_observation_at").cast("timestamp_ntz").alias("newest_observation_at")
        part = cycle["summary"].select("target_id", time, "id", newest, "freshness").unionByName(
            cycle["refused"].select("target_id", time, "reason"), allowMissingColumns=True
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows
