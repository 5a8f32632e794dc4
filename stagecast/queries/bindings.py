"""How the driver's tables stand in for gauges, and the registry of queries.

``events``: a gauge per event type; readings fall into 15-minute slots, so a slot with several
events has several revisions. A value under 1 stands for the source's missing sentinel.
``lineitem`` and ``orders`` give daily series: the step is a day, and so are the horizons.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import DAY, HORIZONS, HOUR, MINUTE, STAGE
from stagecast.functions.columns import (
    content_hash,
    floor_time,
    from_micros,
    sentinel_to_null,
)
from stagecast.operators.revisions import canonical
from stagecast.operators.series import step_means

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DAILY_SPLITS = (
    ("training", date(1995, 1, 1), date(1998, 12, 31)),
    ("validation", date(1999, 1, 1), date(1999, 12, 31)),
    ("calibration", date(2000, 1, 1), date(2000, 12, 31)),
    ("test", date(2001, 1, 1), None),
)
DAILY_START, DAILY_CUTOFF = date(1995, 1, 1), date(2001, 12, 31)
HOURLY_SPLITS = (
    ("training", date(2024, 1, 1), date(2024, 1, 16)),
    ("validation", date(2024, 1, 17), date(2024, 1, 20)),
    ("calibration", date(2024, 1, 21), date(2024, 1, 26)),
    ("test", date(2024, 1, 27), None),
)
HOURLY_CUTOFF = date(2024, 1, 30)


def observations(spark: SparkSession, sf_dir: str, gauge: str | None = None) -> DataFrame:
    """Observation revisions from ``events``; one pooled gauge when a name is given."""
    e = table(spark, sf_dir, "events")
    gauge_id = F.lit(gauge) if gauge else F.col("event_type")
    raw = F.when(F.col("value") < 1, -9999.0).otherwise(F.col("value"))
    return e.select(
        F.lit("events").alias("source"),
        F.concat(gauge_id, F.lit("-value")).alias("time_series_id"),
        gauge_id.alias("gauge_id"),
        F.lit(STAGE).alias("parameter_code"),
        floor_time(F.col("ts"), 15 * MINUTE).alias("event_time"),
        sentinel_to_null(raw).alias("value"),
        F.lit("ft").alias("unit"),
        F.col("ts").alias("first_seen_at"),
        F.col("ts").alias("ingested_at"),
        F.lit(None).cast("timestamp_ntz").alias("source_modified_at"),
        F.array(F.lit("driver")).alias("qualifiers"),
        (F.col("event_type") != "error").alias("approved"),
        content_hash(F.col("event_id").cast("string")).alias("payload_hash"),
    )


def samples(spark: SparkSession, sf_dir: str, gauge: str | None = None) -> DataFrame:
    return canonical(observations(spark, sf_dir, gauge))


def hourly(spark: SparkSession, sf_dir: str, gauge: str | None = None) -> DataFrame:
    return step_means(samples(spark, sf_dir, gauge))


def shipments(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    """Readings from ``lineitem``: quantity at the ship date, a gauge per flag and status."""
    gauge = F.lit("ALL") if pooled else F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        gauge.alias("gauge_id"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_quantity").alias("value"),
    )


def daily(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    return step_means(shipments(spark, sf_dir, pooled), step=DAY)


def daily_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series as readings at midnight."""
    return daily(spark, sf_dir).select(
        F.col("series").alias("gauge_id"),
        from_micros(F.col("idx") * DAY).alias("event_time"),
        "value",
    )


def day_of(idx, step: int = DAY):
    return from_micros(idx * step).cast("date")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def text_day(column):
    return F.date_format(column, "yyyy-MM-dd")


# --- the same bindings in SQL ------------------------------------------------

OBS = """obs AS (
  SELECT event_type AS gauge_id, time_bucket(INTERVAL '15 minutes', ts) AS event_time,
         ts AS ingested_at, sha256(CAST(event_id AS VARCHAR)) AS payload_hash,
         CASE WHEN value < 1 THEN NULL ELSE value END AS value
  FROM events)"""
POOLED_OBS = OBS.replace("SELECT event_type", "SELECT 'ALL'")
CANON = """canon AS (
  SELECT * FROM obs QUALIFY row_number() OVER (
    PARTITION BY gauge_id, event_time ORDER BY ingested_at DESC, payload_hash DESC) = 1)"""
HOURLY_SQL = """hourly AS (
  SELECT gauge_id AS series, epoch_us(event_time) // 3600000000 AS idx, avg(value) AS value
  FROM canon WHERE value IS NOT NULL GROUP BY 1, 2)"""
DAILY_SQL = """daily AS (
  SELECT l_returnflag || l_linestatus AS series,
         CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS idx,
         avg(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
POOLED_DAILY_SQL = DAILY_SQL.replace("l_returnflag || l_linestatus", "'ALL'")


def split_sql(day: str, splits, cutoff: date, open_start: bool = False) -> str:
    """CASE naming the split of a day."""
    parts = []
    for i, (name, first, last) in enumerate(splits):
        low = "" if open_start and i == 0 else f"{day} >= DATE '{first}' AND "
        parts.append(f"WHEN {low}{day} <= DATE '{last or cutoff}' THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


def examples_sql(src: str, step: int) -> str:
    """Examples of a series table as CTEs ``ex`` (wide) and ``exl`` (a row per horizon)."""
    splits, cutoff = (
        (DAILY_SPLITS, DAILY_CUTOFF) if step == DAY else (HOURLY_SPLITS, HOURLY_CUTOFF)
    )
    day = f"CAST(make_timestamp(t.idx * {step}) AS DATE)"
    at = "max(value) OVER (PARTITION BY series ORDER BY idx RANGE BETWEEN {0} AND {0})"
    labels = ", ".join(f"{at.format(f'{h} FOLLOWING')} AS y_{h}" for h in HORIZONS)
    items = ", ".join(f"{{'h': {h}, 'y': y_{h}}}" for h in HORIZONS)
    whole = " AND ".join(f"y_{h} IS NOT NULL" for h in HORIZONS)
    return f"""steps AS (SELECT *, {at.format('1 PRECEDING')} AS prior, {labels} FROM {src}),
ex AS (
  SELECT t.series AS target_id, t.idx, t.value AS x1, t.value - t.prior AS x2,
         {", ".join(f"y_{h}" for h in HORIZONS)}, {split_sql(day, splits, cutoff, True)} AS split
  FROM steps t WHERE prior IS NOT NULL AND {whole}),
exl AS (SELECT target_id, idx, split, x1, x2, unnest([{items}], recursive := true) FROM ex)"""


FIT_SQL = """mom AS (
  SELECT target_id, h, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
         CASE WHEN stddev_pop(x1) = 0 THEN 1.0 ELSE stddev_pop(x1) END AS s1,
         CASE WHEN stddev_pop(x2) = 0 THEN 1.0 ELSE stddev_pop(x2) END AS s2,
         var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
         covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
  FROM exl WHERE split = 'training' GROUP BY 1, 2),
eqs AS (
  SELECT *, n * v1 / (s1 * s1) + CAST(0.001 AS DOUBLE) AS a11,
         n * v2 / (s2 * s2) + CAST(0.001 AS DOUBLE) AS a22,
         n * c12 / (s1 * s2) AS a12, n * c1y / s1 AS b1, n * c2y / s2 AS b2 FROM mom),
fit AS (
  SELECT target_id, h, n, m1, m2, s1, s2, my,
         (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1,
         (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM eqs),
scored AS (
  SELECT e.*, f.my + (e.x1 - f.m1) / f.s1 * f.w1 + (e.x2 - f.m2) / f.s2 * f.w2 AS p
  FROM exl e JOIN fit f USING (target_id, h))"""


