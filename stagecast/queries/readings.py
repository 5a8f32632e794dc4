"""Revisions, regular series and coverage."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import RECONCILIATION_HOURS
from stagecast.functions.columns import (
    content_hash,
    floor_time,
    reconciliation_bounds,
    season,
    split_of,
    stable_id,
)
from stagecast.constants import HOUR
from stagecast.operators import coverage as c
from stagecast.operators import revisions as r
from stagecast.operators import series as s
from stagecast.operators.quantiles import exact_quantiles
from stagecast.queries.bindings import (
    CANON,
    DAILY_CUTOFF,
    DAILY_SPLITS,
    HOURLY_SQL,
    OBS,
    POOLED_OBS,
    hourly,
    observations,
    query,
    rounded,
    samples,
    split_sql,
    table,
    text_day,
)


@query(f"""WITH {OBS}, {CANON}
SELECT gauge_id, event_time, value, payload_hash FROM canon""")
def canonical_latest(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("gauge_id", "event_time", "value", "payload_hash")


@query(f"""WITH {OBS}
SELECT gauge_id, event_time, value, payload_hash FROM obs WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY gauge_id, event_time
  ORDER BY ingested_at DESC, payload_hash DESC) = 1""")
def canonical_keeping_values(spark: SparkSession, d: str) -> DataFrame:
    found = r.canonical(observations(spark, d), r.BY_TIME, ignore_null_revisions=True)
    return found.select("gauge_id", "event_time", "value", "payload_hash")


@query(f"""WITH {OBS}, {CANON}
SELECT gauge_id, event_time, value FROM canon
QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY event_time DESC) <= 50""")
def newest_observations(spark: SparkSession, d: str) -> DataFrame:
    return r.newest(observations(spark, d), 50).select("gauge_id", "event_time", "value")


@query(f"""WITH {OBS}
SELECT gauge_id, event_time, value, payload_hash FROM obs
WHERE gauge_id IN ('view', 'click') AND event_time >= TIMESTAMP '2024-01-05'
  AND event_time < TIMESTAMP '2024-01-20'""")
def observation_scan(spark: SparkSession, d: str) -> DataFrame:
    found = r.scan(
        observations(spark, d), ("view", "click"), "00065", "events",
        datetime(2024, 1, 5), datetime(2024, 1, 20),
    )
    return found.select("gauge_id", "event_time", "value", "payload_hash")


@query(f"""WITH {OBS},
h AS (SELECT gauge_id, event_time, payload_hash, count(*) AS n FROM obs GROUP BY 1, 2, 3),
t AS (SELECT gauge_id, event_time, sum(n) AS n, count(*) AS hashes FROM h GROUP BY 1, 2)
SELECT gauge_id, CAST(sum(n) AS BIGINT) AS revision_rows, count(*) AS observation_times,
  CAST(sum(n) - sum(hashes) AS BIGINT) AS duplicate_revision_rows,
  count(*) FILTER (n > 1) AS observation_times_with_revisions
FROM t GROUP BY 1""")
def revision_statistics(spark: SparkSession, d: str) -> DataFrame:
    return r.revision_statistics(observations(spark, d))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What was stored by the 16th, and what a reconciliation from the 11th brings."""
    obs = observations(spark, d)
    stored = obs.where(F.col("ingested_at") < F.lit(datetime(2024, 1, 16)))
    incoming = obs.where(F.col("ingested_at") >= F.lit(datetime(2024, 1, 11)))
    return stored, incoming.unionByName(incoming)


_HALVES = f"""{OBS},
stored AS (SELECT * FROM obs WHERE ingested_at < TIMESTAMP '2024-01-16'),
incoming AS (SELECT * FROM obs WHERE ingested_at >= TIMESTAMP '2024-01-11')"""


@query(f"""WITH {_HALVES}
SELECT DISTINCT i.gauge_id, i.event_time, i.payload_hash FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.gauge_id = i.gauge_id
  AND s.event_time = i.event_time AND s.payload_hash = i.payload_hash)""")
def revisions_new(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _halves(spark, d)
    return r.new_revisions(incoming, stored).select("gauge_id", "event_time", "payload_hash")


@query(f"""WITH {_HALVES}
SELECT DISTINCT i.gauge_id, i.event_time, i.payload_hash FROM incoming i
WHERE EXISTS (SELECT 1 FROM stored s WHERE s.gauge_id = i.gauge_id
  AND s.event_time = i.event_time AND s.payload_hash = i.payload_hash)""")
def revisions_known(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _halves(spark, d)
    return r.known_revisions(incoming, stored).select("gauge_id", "event_time", "payload_hash")


@query(f"""WITH {OBS}
SELECT 'events' AS source, gauge_id || '-value' AS series_key, max(event_time) AS event_time
FROM obs GROUP BY 2""")
def series_high_water(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _halves(spark, d)
    return r.advance_high_water(r.high_water(stored), incoming)


@query(f"""WITH {OBS}, m AS (SELECT gauge_id, max(event_time) AS newest FROM obs GROUP BY 1),
k AS (SELECT * FROM (VALUES ('frequent', 6), ('nightly', 720), ('monthly', 8784)) t(kind, hours))
SELECT kind, obs.gauge_id, count(*) AS readings, min(event_time) AS earliest
FROM obs JOIN m USING (gauge_id) JOIN k ON event_time >= newest - to_hours(hours)
GROUP BY 1, 2""")
def reconciliation_windows(spark: SparkSession, d: str) -> DataFrame:
    """Readings each kind of reconciliation would fetch again, back from the newest."""
    obs = observations(spark, d).withColumnRenamed("time_series_id", "series_key")
    marks = r.high_water(observations(spark, d)).withColumnRenamed("event_time", "newest")
    aged = obs.join(marks, ["source", "series_key"])
    kinds = F.filter(
        F.array(
            *[
                F.when(F.col("event_time").between(*reconciliation_bounds(kind, F.col("newest"))), kind)
                for kind in RECONCILIATION_HOURS
            ]
        ),
        lambda kind: kind.isNotNull(),
    )
    return (
        aged.select("gauge_id", "event_time", F.explode(kinds).alias("kind"))
        .groupBy("kind", "gauge_id")
        .agg(F.count("*").alias("readings"), F.min("event_time").alias("earliest"))
    )


@query("""SELECT event_id,
  substring(sha256(event_type || '|' || CAST(event_id AS VARCHAR) || '|' ||
    CAST(user_id AS VARCHAR)), 1, 24) AS snapshot_id, sha256(props) AS content_hash
FROM events""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        stable_id(F.col("event_type"), F.col("event_id"), F.col("user_id")).alias("snapshot_id"),
        content_hash(F.col("props")).alias("content_hash"),
    )


@query(f"""WITH {OBS}, {CANON}, {HOURLY_SQL}
SELECT series, idx, round(value, 6) AS value FROM hourly""")
def hourly_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hourly(spark, d), "value")


@query(f"""WITH {OBS}, {CANON}, {HOURLY_SQL}
SELECT h.series, h.idx, round(h.value - p.value, 6) AS change,
  round(ln(1 + greatest(0, h.value)) - ln(1 + greatest(0, p.value)), 6) AS log_change
FROM hourly h JOIN hourly p ON p.series = h.series AND p.idx = h.idx - 1""")
def hourly_changes(spark: SparkSession, d: str) -> DataFrame:
    series = hourly(spark, d)
    plain = s.step_changes(series, width=168)
    logs = s.step_changes(series, log=True, width=168).withColumnRenamed("change", "log_change")
    return rounded(plain.join(logs, ["series", "idx"]), "change", "log_change")


@query(f"""WITH {OBS}, {CANON}, {HOURLY_SQL},
span AS (SELECT series, min(idx) AS a, max(idx) AS b FROM hourly GROUP BY 1),
spine AS (SELECT series, unnest(range(a, b + 1)) AS idx FROM span)
SELECT s.series, s.idx, round(h.value, 6) AS value
FROM spine s LEFT JOIN hourly h ON h.series = s.series AND h.idx = s.idx""")
def dense_hours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(s.densify(hourly(spark, d), width=168), "value")


@query(f"""WITH {OBS}, b AS (SELECT DISTINCT gauge_id, event_time FROM obs WHERE value IS NOT NULL)
SELECT gauge_id, count(*) AS populated_bins, round(count(*) / 2880.0, 6) AS coverage
FROM b GROUP BY 1""")
def quarter_hour_coverage(spark: SparkSession, d: str) -> DataFrame:
    readings = observations(spark, d).withColumn("event_time", F.col("ingested_at"))
    return rounded(s.quarter_hour_coverage(readings, 30 * 96), "coverage")


@query(f"""WITH {OBS}, {CANON}, g AS (
  SELECT gauge_id, epoch_us(event_time) - lag(epoch_us(event_time)) OVER
    (PARTITION BY gauge_id ORDER BY event_time) AS gap FROM canon)
SELECT gauge_id, count(*) FILTER (gap > 1800000000) AS over_30_minutes,
  count(*) FILTER (gap > 21600000000) AS over_6_hours,
  count(*) FILTER (gap > 86400000000) AS over_24_hours,
  round(coalesce(max(gap) FILTER (gap > 1800000000), 0) / 3600000000.0, 6) AS longest_hours
FROM g GROUP BY 1""")
def gap_summary(spark: SparkSession, d: str) -> DataFrame:
    found = s.gap_summary(samples(spark, d), width=72 * HOUR)
    return rounded(found, "longest_hours")


@query(f"""WITH {OBS}, {CANON}
SELECT gauge_id, count(value) AS valid_samples, count(*) - count(value) AS null_samples,
  min(value) AS minimum, max(value) AS maximum, round(median(value), 6) AS median
FROM canon GROUP BY 1""")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(s.value_summary(samples(spark, d)), "median")


@query(f"""WITH {OBS}, {CANON}
SELECT gauge_id, count(*) AS samples, min(event_time) AS first_observation,
  max(event_time) AS last_observation, CAST(2880 AS BIGINT) AS expected_samples,
  round(count(*) / 2880.0, 6) AS coverage_fraction, count(*) / 2880.0 >= 0.9 AS complete
FROM canon GROUP BY 1""")
def overall_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = c.overall_coverage(samples(spark, d), date(2024, 1, 1), date(2024, 1, 30))
    return rounded(found, "coverage_fraction")


ORDER_START, ORDER_END = date(1995, 1, 15), date(2001, 8, 1)


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    """Days with orders by status and priority, as daily samples."""
    return (
        table(spark, d, "orders")
        .groupBy(
            F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("gauge_id"),
            F.col("o_orderdate").alias("event_time"),
        )
        .agg(F.max("o_totalprice").alias("value"))
    )


_ORDER_DAYS = """days AS (
  SELECT o_orderstatus || '/' || o_orderpriority AS gauge_id, o_orderdate AS event_time,
         max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""
_MONTHLY = f"""{_ORDER_DAYS},
months AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01',
  INTERVAL 1 MONTH)) AS month),
spine AS (SELECT gauge_id, CAST(month AS DATE) AS month
  FROM (SELECT DISTINCT gauge_id FROM days), months),
counts AS (SELECT gauge_id, CAST(date_trunc('month', event_time) AS DATE) AS month,
  count(*) AS observed FROM days GROUP BY 1, 2),
monthly AS (
  SELECT s.gauge_id, s.month, coalesce(k.observed, 0) AS observed,
    greatest(0, date_diff('day', greatest(s.month, DATE '1995-01-15'),
      least(last_day(s.month), DATE '2001-08-01')) + 1) AS expected
  FROM spine s LEFT JOIN counts k ON k.gauge_id = s.gauge_id AND k.month = s.month)"""


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    days = _order_days(spark, d)
    return c.monthly_coverage(days, days, ORDER_START, ORDER_END, per_day=1)


@query(f"""WITH {_MONTHLY}
SELECT gauge_id, strftime(month, '%Y-%m') AS month, observed, expected,
  round(observed / nullif(expected, 0), 6) AS coverage FROM monthly""")
def monthly_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = _monthly(spark, d).withColumn("month", F.date_format("month", "yyyy-MM"))
    return rounded(found, "coverage")


@query(f"""WITH {_MONTHLY}
SELECT gauge_id, CASE WHEN month(month) IN (12, 1, 2) THEN 'winter'
  WHEN month(month) IN (3, 4, 5) THEN 'spring' WHEN month(month) IN (6, 7, 8) THEN 'summer'
  ELSE 'autumn' END AS season, round(avg(observed / nullif(expected, 0)), 6) AS mean_coverage
FROM monthly GROUP BY 1, 2""")
def seasonal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.seasonal_coverage(_monthly(spark, d)), "mean_coverage")


@query(f"""WITH {_MONTHLY}
SELECT gauge_id, strftime(month, '%Y-%m') AS month, round(observed / expected, 6) AS coverage
FROM monthly WHERE expected > 0 AND observed / expected < 0.9""")
def low_coverage_months(spark: SparkSession, d: str) -> DataFrame:
    low = c.low_months(_monthly(spark, d)).withColumn("month", F.date_format("month", "yyyy-MM"))
    return rounded(low.select("gauge_id", "month", "coverage"), "coverage")


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS month,
  CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter'
  WHEN month(l_shipdate) IN (3, 4, 5) THEN 'spring' WHEN month(l_shipdate) IN (6, 7, 8)
  THEN 'summer' ELSE 'autumn' END AS season,
  CAST((date_diff('day', date_trunc('month', l_shipdate), last_day(l_shipdate)) + 1) * 96 AS BIGINT)
    AS expected, count(*) AS readings
FROM lineitem GROUP BY 1, 2, 3""")
def seasons_and_expected_samples(spark: SparkSession, d: str) -> DataFrame:
    from stagecast.functions.columns import expected_samples

    month = F.trunc(F.col("l_shipdate").cast("date"), "MM")
    per_month = table(spark, d, "lineitem").groupBy(month.alias("m")).agg(F.count("*").alias("readings"))
    return per_month.select(
        F.date_format("m", "yyyy-MM").alias("month"),
        season(F.month("m")).alias("season"),
        expected_samples(F.col("m"), F.lit(date(1990, 1, 1)), F.lit(date(2010, 1, 1))).alias("expected"),
        "readings",
    )


def _order_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Archived months: those with an order over 400,000."""
    days = _order_days(spark, d).where(F.col("value") > 400_000)
    return days.select(
        F.lit("usgs").alias("source"),
        F.concat_ws(
            "/", F.lit("continuous"), F.translate("gauge_id", "/", "_"), F.lit("00065"),
            F.date_format("event_time", "yyyy-MM"),
        ).alias("resource"),
    )


_CATALOGUE = f"""{_ORDER_DAYS},
gauges AS (SELECT DISTINCT replace(gauge_id, '/', '_') AS gauge_id FROM days),
archived AS (SELECT DISTINCT replace(gauge_id, '/', '_') AS gauge_id,
  strftime(event_time, '%Y-%m') AS month FROM days WHERE value > 400000)"""


def _order_gauges(spark: SparkSession, d: str) -> DataFrame:
    return _order_days(spark, d).select(F.translate("gauge_id", "/", "_").alias("gauge_id")).distinct()


@query(f"""WITH {_CATALOGUE}, months AS (SELECT unnest(generate_series(DATE '1995-01-01',
  DATE '2001-08-01', INTERVAL 1 MONTH)) AS m),
spine AS (SELECT gauge_id, CAST(m AS DATE) AS m FROM gauges, months)
SELECT gauge_id, 'continuous/' || gauge_id || '/00065/' || strftime(m, '%Y-%m') AS resource,
  strftime(greatest(m, DATE '1995-01-15'), '%Y-%m-%d') AS begin_day,
  strftime(least(CAST(m + INTERVAL 1 MONTH AS DATE), DATE '2001-08-02'), '%Y-%m-%d') AS finish_day
FROM spine s WHERE NOT EXISTS (SELECT 1 FROM archived a WHERE a.gauge_id = s.gauge_id
  AND a.month = strftime(s.m, '%Y-%m'))""")
def missing_partitions(spark: SparkSession, d: str) -> DataFrame:
    expected = c.expected_partitions(_order_gauges(spark, d), ("00065",), ORDER_START, ORDER_END)
    return c.missing_partitions(expected, _order_catalogue(spark, d)).select(
        "gauge_id", "resource", text_day("begin").alias("begin_day"), text_day("finish").alias("finish_day")
    )


@query(f"""WITH {_CATALOGUE}, n AS (SELECT gauge_id, count(*) AS complete FROM archived GROUP BY 1)
SELECT gauge_id, '00065' AS parameter_code, coalesce(complete, 0) AS complete,
  CAST(80 AS BIGINT) AS required
FROM gauges LEFT JOIN n USING (gauge_id) WHERE coalesce(complete, 0) < 80""")
def incomplete_series(spark: SparkSession, d: str) -> DataFrame:
    required = _order_gauges(spark, d).withColumn("parameter_code", F.lit("00065"))
    return c.incomplete_series(required, c.archived_partitions(_order_catalogue(spark, d)), 80)


@query("""WITH t AS (SELECT l_returnflag || l_linestatus AS gauge_id, l_extendedprice AS v
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
p AS (SELECT unnest([0.5, 0.95, 0.99]) AS probability)
SELECT gauge_id, CAST(probability AS DOUBLE) AS probability,
  round(CASE probability WHEN 0.5 THEN a WHEN 0.95 THEN b ELSE c END, 6) AS quantile, group_size
FROM (SELECT gauge_id, quantile_cont(v, 0.5) AS a, quantile_cont(v, 0.95) AS b,
  quantile_cont(v, 0.99) AS c, count(*) AS group_size FROM t GROUP BY 1), p""")
def training_percentiles(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "lineitem").where(
        F.col("l_shipdate") < F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz")
    ).select(F.concat("l_returnflag", "l_linestatus").alias("gauge_id"), "l_extendedprice")
    return rounded(exact_quantiles(train, ["gauge_id"], "l_extendedprice", (0.5, 0.95, 0.99)), "quantile")


_SPLIT = split_sql("CAST(l_shipdate AS DATE)", DAILY_SPLITS, DAILY_CUTOFF)


@query(f"""SELECT {_SPLIT} AS split, count(*) AS readings, round(sum(l_quantity), 6) AS quantity
FROM lineitem GROUP BY 1""")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return (
        table(spark, d, "lineitem")
        .groupBy(split_of(day, DAILY_CUTOFF, DAILY_SPLITS).alias("split"))
        .agg(F.count("*").alias("readings"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
    )


@query(f"""WITH {POOLED_OBS}, {CANON}
SELECT gauge_id, time_bucket(INTERVAL '1 hour', event_time) AS hour, count(*) AS samples
FROM canon GROUP BY 1, 2""")
def pooled_hours(spark: SparkSession, d: str) -> DataFrame:
    return (
        samples(spark, d, "ALL")
        .groupBy("gauge_id", floor_time(F.col("event_time"), HOUR).alias("hour"))
        .agg(F.count("*").alias("samples"))
    )
