"""Travel lags and candidate selection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.operators import series as s
from stagecast.operators import upstream as u
from stagecast.plans.audits import upstream_analysis, upstream_selection
from stagecast.queries.bindings import (
    CANON,
    HOURLY_SQL,
    OBS,
    hourly,
    observations,
    query,
    rounded,
    samples,
    table,
)

MINIMUM_PAIRS = 100


def links(spark: SparkSession, d: str) -> DataFrame:
    """Every other event type as an upstream gauge of clicks and errors."""
    kinds = table(spark, d, "events").select(F.col("event_type").alias("gauge_id")).distinct()
    return kinds.withColumn("target_id", F.explode(F.array(F.lit("click"), F.lit("error")))).where(
        F.col("gauge_id") != F.col("target_id")
    )


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    series = hourly(spark, d)
    return u.lag_sweep(
        s.step_changes(series, log=True, width=168), s.step_changes(series, width=168),
        links(spark, d), 72, MINIMUM_PAIRS, width=168,
    )


_SWEEP = f"""{OBS}, {CANON}, {HOURLY_SQL},
links AS (SELECT g.gauge_id, t.target_id FROM (SELECT DISTINCT event_type AS gauge_id FROM events) g
  CROSS JOIN (VALUES ('click'), ('error')) t(target_id) WHERE g.gauge_id <> t.target_id),
up AS (SELECT h.series, h.idx, ln(1 + greatest(0, h.value)) - ln(1 + greatest(0, p.value)) AS x
  FROM hourly h JOIN hourly p ON p.series = h.series AND p.idx = h.idx - 1),
tg AS (SELECT h.series, h.idx, h.value - p.value AS y
  FROM hourly h JOIN hourly p ON p.series = h.series AND p.idx = h.idx - 1),
spine AS (SELECT target_id, gauge_id, lag_hours FROM links, range(0, 73) r(lag_hours)),
pairs AS (SELECT l.target_id, l.gauge_id, l.lag_hours, x, y FROM spine l
  JOIN up ON up.series = l.gauge_id
  JOIN tg ON tg.series = l.target_id AND tg.idx = up.idx + l.lag_hours),
swept AS (SELECT target_id, gauge_id, lag_hours, count(*) AS n,
  covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS c FROM pairs GROUP BY 1, 2, 3),
sweep AS (SELECT target_id, gauge_id, lag_hours, coalesce(n, 0) AS paired_hours,
  CASE WHEN n >= {MINIMUM_PAIRS} THEN c END AS correlation
  FROM spine LEFT JOIN swept USING (target_id, gauge_id, lag_hours)),
selected AS (SELECT target_id, gauge_id, lag_hours, correlation, paired_hours FROM sweep
  WHERE correlation > 0 QUALIFY row_number() OVER (PARTITION BY target_id, gauge_id
    ORDER BY correlation DESC, lag_hours) = 1)"""


@query(f"""WITH {_SWEEP} SELECT target_id, gauge_id, CAST(lag_hours AS BIGINT) AS lag_hours,
  paired_hours, round(correlation, 6) AS correlation FROM sweep""")
def lag_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = _sweep(spark, d).withColumn("lag_hours", F.col("lag_hours").cast("bigint"))
    return rounded(found, "correlation")


@query(f"""WITH {_SWEEP} SELECT l.target_id, l.gauge_id, CAST(lag_hours AS BIGINT) AS lag_hours,
  round(correlation, 6) AS correlation, paired_hours
FROM links l LEFT JOIN selected USING (target_id, gauge_id)""")
def lag_selected(spark: SparkSession, d: str) -> DataFrame:
    found = u.select_lags(_sweep(spark, d)).withColumn("lag_hours", F.col("lag_hours").cast("bigint"))
    return rounded(found, "correlation")


_QUALIFIED = f"""{_SWEEP},
cover AS (SELECT gauge_id, count(*) / 2880.0 AS coverage FROM canon WHERE value IS NOT NULL GROUP BY 1),
qualified AS (SELECT l.target_id, l.gauge_id, CAST(lag_hours AS BIGINT) AS lag_hours,
  round(coverage, 6) AS coverage, coalesce(coverage >= 0.45, false) AND lag_hours IS NOT NULL AS suitable
  FROM links l LEFT JOIN selected USING (target_id, gauge_id) LEFT JOIN cover USING (gauge_id))"""


def _qualified(spark: SparkSession, d: str) -> DataFrame:
    cover = s.quarter_hour_coverage(samples(spark, d), 2880)
    return u.qualify(u.select_lags(_sweep(spark, d)), cover, 0.45)


@query(f"WITH {_QUALIFIED} SELECT * FROM qualified")
def upstream_qualified(spark: SparkSession, d: str) -> DataFrame:
    found = _qualified(spark, d).select(
        "target_id", "gauge_id", F.col("lag_hours").cast("bigint").alias("lag_hours"), "coverage", "suitable"
    )
    return rounded(found, "coverage")


@query(f"""WITH {_QUALIFIED} SELECT target_id, count(*) FILTER (suitable) AS suitable_gauges,
  count(*) FILTER (suitable) >= 3 AS minimum_three_suitable_met FROM qualified GROUP BY 1""")
def upstream_enough(spark: SparkSession, d: str) -> DataFrame:
    return u.enough_suitable(_qualified(spark, d))


_TRAINING = _SWEEP.replace(
    "FROM canon WHERE value", "FROM canon WHERE event_time < TIMESTAMP '2024-01-21' AND value"
)


@query(f"""WITH {_TRAINING},
cover AS (SELECT gauge_id, count(*) / 2880.0 AS coverage FROM canon WHERE value IS NOT NULL GROUP BY 1)
SELECT l.target_id, l.gauge_id, CAST(lag_hours AS BIGINT) AS lag_hours, round(correlation, 6) AS correlation,
  paired_hours, round(coverage, 6) AS coverage, coalesce(coverage >= 0.45, false) AND lag_hours IS NOT NULL AS suitable
FROM links l LEFT JOIN selected USING (target_id, gauge_id) LEFT JOIN cover USING (gauge_id)""")
def upstream_analysis_report(spark: SparkSession, d: str) -> DataFrame:
    """Coverage over all readings, lags from training readings only."""
    rows = observations(spark, d)
    report = upstream_analysis(
        rows, links(spark, d), None, date(2024, 1, 1), date(2024, 1, 30), date(2024, 1, 20), "events",
        "00065", "00065", 72, MINIMUM_PAIRS, 0.45,
    )
    found = report["qualified"].withColumn("lag_hours", F.col("lag_hours").cast("bigint"))
    return rounded(found, "correlation", "coverage")


# a nation is a target gauge's basin: its suppliers are the connected sites, the first of them the
# target; the balance tells the mainstem from a tributary
def topology(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier")
    first = sup.groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("target_id"))
    return sup.join(first, "s_nationkey").select(
        "target_id",
        F.col("s_suppkey").alias("pos"),
        F.concat(F.lit("USGS-"), F.col("s_suppkey")).alias("identifier"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") >= 4000, "main").otherwise("side").alias("mainstem"),
        F.col("s_suppkey").alias("comid"),
    )


def series_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Series of each supplier from its shipments: stage from returns, flow from acceptances."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        F.min("l_shipdate").alias("b"), F.max("l_shipdate").alias("e")
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return rows.select(
        F.concat_ws("-", "l_suppkey", "l_returnflag", "l_linestatus").alias("id"),
        F.concat(F.lit("USGS-"), F.col("l_suppkey")).alias("monitoring_location_id"),
        F.when(F.col("l_returnflag") == "R", "00065").otherwise("00060").alias("parameter_code"),
        F.lit("00011").alias("statistic_id"),
        F.lit("Primary").alias("primary"),
        F.when(F.col("l_returnflag") == "N", "Daily").otherwise("Points").alias("computation_period_identifier"),
        F.date_format("b", iso).alias("begin"),
        F.date_format("e", iso).alias("end"),
    )


START, CUTOFF = date(1995, 1, 1), date(2001, 11, 4)
_SERIES = """meta AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS gauge_id, l_suppkey || '-' || l_returnflag || '-' || l_linestatus AS id,
    CASE WHEN l_returnflag = 'R' THEN '00065' ELSE '00060' END AS parameter_code,
    min(l_shipdate) AS b, max(l_shipdate) AS e
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_suppkey, l_returnflag, l_linestatus),
preferred AS (SELECT * FROM meta QUALIFY row_number() OVER (
  PARTITION BY gauge_id, parameter_code ORDER BY e DESC, b, id) = 1)"""
_CANDIDATES = f"""{_SERIES},
topo AS (SELECT CAST(min(s_suppkey) OVER (PARTITION BY s_nationkey) AS VARCHAR) AS target_id,
  CAST(s_suppkey AS VARCHAR) AS gauge_id, CASE WHEN s_acctbal >= 4000 THEN 'main' ELSE 'side' END AS mainstem
  FROM supplier),
spans AS (SELECT gauge_id, max(id) FILTER (parameter_code = '00065') AS stage_id,
  max(id) FILTER (parameter_code = '00060') AS flow_id, min(epoch_us(b)) AS b, max(epoch_us(e)) AS e
  FROM preferred GROUP BY 1),
candidates AS (SELECT t.target_id, t.gauge_id, t.mainstem = g.mainstem AS is_target_mainstem, stage_id, flow_id,
  greatest(0.0, (least(e, epoch_us(TIMESTAMP '2001-11-05') - 1) - greatest(b, epoch_us(TIMESTAMP '1995-01-01')))
    / (epoch_us(TIMESTAMP '2001-11-05') - 1 - epoch_us(TIMESTAMP '1995-01-01'))) AS overlap
  FROM topo t JOIN spans USING (gauge_id) JOIN topo g ON g.target_id = t.target_id AND g.gauge_id = t.target_id
  WHERE t.gauge_id <> t.target_id),
ranked AS (SELECT *, row_number() OVER w AS rank, row_number() OVER s AS side_rank FROM candidates
  WHERE overlap >= 0.5
  WINDOW w AS (PARTITION BY target_id ORDER BY is_target_mainstem DESC,
    (stage_id IS NOT NULL AND flow_id IS NOT NULL) DESC, overlap DESC, gauge_id),
  s AS (PARTITION BY target_id, is_target_mainstem ORDER BY
    (stage_id IS NOT NULL AND flow_id IS NOT NULL) DESC, overlap DESC, gauge_id)),
selected AS (SELECT target_id, gauge_id, is_target_mainstem, row_number() OVER (
    PARTITION BY target_id ORDER BY is_target_mainstem DESC, side_rank) AS rank
  FROM ranked WHERE side_rank <= CASE WHEN is_target_mainstem THEN 5 ELSE 3 END)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return u.connected_candidates(
        topology(spark, d), u.preferred_series(series_metadata(spark, d)), START, CUTOFF
    )


@query(f"""WITH {_SERIES} SELECT gauge_id, parameter_code, id,
  strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS begin, strftime(e, '%Y-%m-%dT%H:%M:%SZ') AS "end" FROM preferred""")
def preferred_series(spark: SparkSession, d: str) -> DataFrame:
    return u.preferred_series(series_metadata(spark, d))


@query(f"""WITH {_CANDIDATES} SELECT target_id, gauge_id, is_target_mainstem, round(overlap, 6) AS overlap, rank
FROM ranked WHERE rank <= 8""")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    found = u.rank_candidates(_candidates(spark, d)).select(
        "target_id", "gauge_id", "is_target_mainstem", F.col("nominal_overlap_fraction").alias("overlap"), "rank"
    )
    return rounded(found, "overlap")


@query(f"WITH {_CANDIDATES} SELECT target_id, gauge_id, is_target_mainstem, rank FROM selected")
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    return u.select_candidates(_candidates(spark, d)).select(
        "target_id", "gauge_id", "is_target_mainstem", "rank"
    )


@query(f"""WITH {_CANDIDATES}, n AS (SELECT *, row_number() OVER (
  PARTITION BY target_id, is_target_mainstem ORDER BY rank) AS k FROM selected)
SELECT target_id, gauge_id, is_target_mainstem, rank FROM n
WHERE k <= CASE WHEN is_target_mainstem THEN 3 ELSE 1 END""")
def lean_selection(spark: SparkSession, d: str) -> DataFrame:
    return u.lean_selection(u.select_candidates(_candidates(spark, d))).select(
        "target_id", "gauge_id", "is_target_mainstem", "rank"
    )


_FORCED = f"""{_CANDIDATES},
proxies AS (SELECT CAST(min(s_suppkey) AS VARCHAR) AS target_id, CAST(max(s_suppkey) AS VARCHAR) AS proxy
  FROM supplier GROUP BY s_nationkey HAVING min(s_suppkey) % 3 <> 0),
regular AS (SELECT target_id, gauge_id, is_target_mainstem, side_rank, false AS forced FROM ranked
  WHERE side_rank <= CASE WHEN is_target_mainstem THEN 2 ELSE 1 END),
added AS (SELECT c.target_id, c.gauge_id, c.is_target_mainstem, 0 AS side_rank, true AS forced FROM candidates c
  JOIN proxies p ON p.target_id = c.target_id AND p.proxy = c.gauge_id
  WHERE NOT EXISTS (SELECT 1 FROM regular r WHERE r.target_id = c.target_id AND r.gauge_id = c.gauge_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY forced, is_target_mainstem DESC, side_rank) AS position,
  bool_or(forced) OVER (PARTITION BY target_id) AS has_forced FROM (SELECT * FROM regular UNION ALL SELECT * FROM added)),
chosen AS (SELECT target_id, gauge_id, is_target_mainstem, least(position, 2) AS rank, CASE WHEN forced THEN 'forced'
  WHEN is_target_mainstem THEN 'mainstem' ELSE 'tributary' END AS why
  FROM placed WHERE forced OR position <= CASE WHEN has_forced THEN 1 ELSE 2 END),
lean AS (SELECT c.*, proxy, row_number() OVER (PARTITION BY target_id, is_target_mainstem ORDER BY rank) AS k
  FROM chosen c LEFT JOIN proxies USING (target_id))"""


def _forced(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The selection plan where two of three nations must keep their last supplier; a row per nation."""
    ends = table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last")
    )
    proxies = {str(r.first): str(r.last) for r in ends.where("first % 3 <> 0").collect()}
    return upstream_selection(
        topology(spark, d), series_metadata(spark, d), START, CUTOFF, proxies, lean=1, mainstem=2, tributaries=1, limit=2
    )


@query(f"""WITH {_FORCED} SELECT 'selected' AS part, target_id, gauge_id, is_target_mainstem, rank, why FROM chosen
UNION ALL SELECT 'model_selected', target_id, gauge_id, is_target_mainstem, rank, why FROM lean
WHERE (is_target_mainstem AND k <= 1) OR CASE WHEN proxy IS NOT NULL THEN gauge_id = proxy
  ELSE NOT is_target_mainstem AND k = 1 END""")
def forced_selection(spark: SparkSession, d: str) -> DataFrame:
    """Selection and lean selection with required gauges, whatever their overlap or rank."""
    report = _forced(spark, d)
    reason = F.col("selection_reason")
    why = F.when(reason.startswith("required"), "forced").when(reason.contains("mainstem"), "mainstem").otherwise("tributary")
    rows = [
        report[part].select(F.lit(part).alias("part"), "target_id", "gauge_id", "is_target_mainstem", "rank", why.alias("why"))
        for part in ("selected", "model_selected")
    ]
    return rows[0].unionByName(rows[1])


@query(f"WITH {_FORCED} SELECT DISTINCT gauge_id, '00060' AS parameter_code FROM chosen")
def acquisition_gauges(spark: SparkSession, d: str) -> DataFrame:
    """Each selected gauge once, with what to fetch."""
    return _forced(spark, d)["acquisition"]


@query("""WITH t AS (SELECT CAST(s_nationkey AS VARCHAR) AS target_id, CAST(s_suppkey AS VARCHAR) AS gauge_id,
  (row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_suppkey AS VARCHAR)) - 1) // 40 AS chunk
  FROM supplier)
SELECT target_id, chunk, string_agg(gauge_id, ',' ORDER BY gauge_id) AS gauges FROM t GROUP BY 1, 2""")
def request_chunks(spark: SparkSession, d: str) -> DataFrame:
    gauges = table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("target_id"), F.col("s_suppkey").cast("string").alias("gauge_id")
    )
    found = u.request_chunks(gauges)
    return found.select("target_id", "chunk", F.array_join("gauge_ids", ",").alias("gauges"))
