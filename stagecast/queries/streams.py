"""Streaming ingestion and event state, run to the end of what has landed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import DAY
from stagecast.operators.revisions import canonical
from stagecast.operators.triggers import coalesced_triggers as coalesce_triggers
from stagecast.queries.bindings import CANON, OBS, observations, query, rounded, table
from stagecast.queries.episodes import EVENT_SQL, event_readings
from stagecast.queries.sources import messages
from stagecast.session import scratch
from stagecast.sources.envelopes import decode
from stagecast.streaming import compaction as sc
from stagecast.streaming import events as se
from stagecast.streaming import ingest as si
from stagecast.streaming import live, retention


DELIVERIES = (None, datetime(2024, 1, 11), datetime(2024, 1, 21), None)


def _deliveries(df: DataFrame, time: str) -> list[DataFrame]:
    """The rows in three parts, one after the other."""
    at, parts = F.col(time), []
    for first, after in zip(DELIVERIES, DELIVERIES[1:]):
        part = df if first is None else df.where(at >= F.lit(first).cast("timestamp_ntz"))
        parts.append(part if after is None else part.where(at < F.lit(after).cast("timestamp_ntz")))
    return parts


def _land(part: DataFrame, path: str) -> int:
    """Write a delivery with all cores; the most files it can have."""
    files = max(3, part.sparkSession.sparkContext.defaultParallelism)
    part.repartition(files).write.mode("append").text(path)
    return files


def _ingested(spark: SparkSession, d: str) -> str:
    """Land the encoded events and take them in, a delivery per batch."""
    landing, root, checkpoint = scratch(spark, "landing"), scratch(spark, "table"), scratch(spark, "checkpoint")
    for part in _deliveries(observations(spark, d), "ingested_at"):
        files = _land(messages(part).select("value"), landing)
        si.run_available(si.file_values(spark, landing, files_per_batch=files), root, checkpoint)
    return root


@query(f"""WITH {OBS} SELECT gauge_id, event_time, value, payload_hash FROM obs WHERE value <= 200""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    found = si.revisions_table(spark, _ingested(spark, d))
    return found.select(
        "gauge_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "value", "payload_hash"
    )


@query(f"""WITH {OBS} SELECT CASE WHEN value IS NULL THEN 'unsupported observation event'
  ELSE 'no raw payload object' END AS reason, count(*) AS events
FROM obs WHERE value IS NULL OR value > 200 GROUP BY 1""")
def stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    dead = si.dead_letter_table(spark, _ingested(spark, d))
    return dead.groupBy("reason").agg(F.count("*").alias("events"))


@query(f"""WITH {OBS} SELECT gauge_id || '-value' AS series_key, max(event_time) AS event_time
FROM obs WHERE value <= 200 GROUP BY 1""")
def stream_high_water(spark: SparkSession, d: str) -> DataFrame:
    return si.high_water_table(spark, _ingested(spark, d)).select(
        "series_key", F.col("event_time").cast("timestamp_ntz").alias("event_time")
    )


@query(f"""WITH o AS (WITH {OBS} SELECT * FROM obs WHERE value <= 200), {CANON.replace("FROM obs", "FROM o")}
SELECT gauge_id, count(*) AS observations, CAST(0 AS BIGINT) AS differing FROM canon GROUP BY 1""")
def stream_parity(spark: SparkSession, d: str) -> DataFrame:
    """The canonical series of the streamed table against that of the batch path."""
    streamed = canonical(si.revisions_table(spark, _ingested(spark, d)))
    batch = canonical(decode(messages(observations(spark, d))))
    keys = ["gauge_id", "event_time"]
    both = streamed.select(*keys, F.col("payload_hash").alias("a")).join(
        batch.select(*keys, F.col("payload_hash").alias("b")), keys, "full_outer"
    )
    return both.groupBy("gauge_id").agg(
        F.count("*").alias("observations"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing")
    )


@query(f"""WITH {OBS} SELECT gauge_id, event_time, value, payload_hash FROM obs""")
def direct_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same deliveries stored without a stream, the second one twice."""
    root = scratch(spark, "direct")
    first, second, third = _direct(spark, d)
    for batch_id, part in enumerate((first, second, second, third)):
        si.ingest(part, "direct", root, batch_id=batch_id)
    found = si.revisions_table(spark, root)
    return found.select(
        "gauge_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "value", "payload_hash"
    )


@query(f"""WITH {OBS} SELECT gauge_id, event_time, value, payload_hash FROM obs""")
def compacted_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with a compaction after each, the second one replayed, old folders released."""
    root = scratch(spark, "compacted")
    first, second, third = _direct(spark, d)
    for batch_id, part in ((0, first), (1, second), (1, second), (2, third)):
        si.ingest(part, "direct", root, batch_id=batch_id)
        sc.compact(spark, root, open_months=0)
        sc.release(spark, root)
    return si.revisions_table(spark, root).select(
        "gauge_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "value", "payload_hash"
    )


@query(f"""WITH {OBS} SELECT gauge_id || '-value' AS series_key, max(event_time) AS event_time FROM obs GROUP BY 1""")
def direct_high_water(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "direct")
    for part in _direct(spark, d):
        si.ingest(part, "direct", root)
    return si.high_water_table(spark, root).select(
        "series_key", F.col("event_time").cast("timestamp_ntz").alias("event_time")
    )


def _direct(spark: SparkSession, d: str) -> list[DataFrame]:
    rows = observations(spark, d).withColumn("raw_payload", F.create_map(F.lit("archive_hash"), F.col("payload_hash")))
    return _deliveries(rows, "ingested_at")


def _observed(spark: SparkSession, d: str, order: tuple[int, ...]) -> tuple[str, DataFrame]:
    """Take the deliveries of event readings in, in an order; the root and all readings."""
    landing, root, checkpoint = scratch(spark, "readings"), scratch(spark, "events"), scratch(spark, "checkpoint")
    readings = event_readings(spark, d)
    parts = _deliveries(readings, "at")
    times = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}
    for i in order:
        files = _land(parts[i].select(F.to_json(F.struct(*readings.columns), times).alias("value")), landing)
        values = se.reading_values(spark, landing, files_per_batch=files)
        si.run_available(values, root, checkpoint, se.observe_batch)
    return root, readings


@query(EVENT_SQL)
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Transitions from micro-batches that carry the state on."""
    root, _ = _observed(spark, d, (0, 1, 2))
    return se.transition_table(spark, root).select(
        "gauge_id", "seq", F.col("at").cast("timestamp_ntz").alias("event_time"), "transition"
    )


@query(EVENT_SQL)
def stream_events_late(spark: SparkSession, d: str) -> DataFrame:
    """The same transitions though the middle delivery comes last."""
    root, readings = _observed(spark, d, (0, 2, 1))
    whole = readings.withColumn("at", F.col("at").cast("timestamp")).select(
        *[f.name for f in spark.createDataFrame([], se.READING).schema]
    )
    return se.corrected(spark, root, whole).select(
        "gauge_id", "seq", F.col("at").cast("timestamp_ntz").alias("event_time"), "transition"
    )


def _triggers(spark: SparkSession, d: str) -> DataFrame:
    """A trigger per event; a high value stands for a correction."""
    kind = F.when(F.col("value") >= 60, "correction").otherwise("batch")
    return table(spark, d, "events").select(
        F.col("event_type").alias("target_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")
    )


_GROUPS = """t AS (SELECT event_type AS target_id, ts, CASE WHEN value >= 60 THEN 'correction' ELSE 'batch' END AS kind FROM events),
s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY target_id ORDER BY ts) <= 300000000
  THEN 0 ELSE 1 END AS fresh FROM t),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY target_id ORDER BY ts) AS grp FROM s),
groups AS (SELECT target_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS triggers,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM g GROUP BY target_id, grp)"""


def _shown(groups: DataFrame) -> DataFrame:
    ntz = {n: F.col(n).cast("timestamp_ntz") for n in ("first_at", "last_at")}
    return groups.withColumns({**ntz, "kinds": F.array_join("kinds", ",")})


@query(f"WITH {_GROUPS} SELECT * FROM groups")
def trigger_groups(spark: SparkSession, d: str) -> DataFrame:
    """Triggers within five minutes of each other, as one."""
    return _shown(coalesce_triggers(_triggers(spark, d), width=2 * DAY))


def _landed(parts: list[DataFrame], path: str) -> None:
    for part in parts:
        part.repartition(3).write.mode("append").parquet(path)


@query(f"""WITH {_GROUPS} SELECT * FROM groups
WHERE last_at + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_trigger_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same groups from a stream, as far as its watermark has passed them."""
    path, out = scratch(spark, "triggers"), scratch(spark, "trigger-groups")
    _landed(_deliveries(_triggers(spark, d), "at"), path)
    live.run_view(live.live_sessions(live.landed(spark, path, live.TRIGGER, 3)), out, scratch(spark, "checkpoint"))
    return _shown(spark.read.parquet(out))


def _late_order(spark: SparkSession, d: str) -> list[DataFrame]:
    """Deliveries of readings, the middle one last and so behind the watermark."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("gauge_id"), F.col("ts").cast("timestamp").alias("at"), "value"
    )
    first, second, third = _deliveries(rows, "at")
    return [first, third, second]


@query("""SELECT event_type AS gauge_id, time_bucket(INTERVAL 1 HOUR, ts) AS starts_at, count(*) AS readings,
  round(avg(value), 6) AS mean, max(value) AS most FROM events
WHERE ts < TIMESTAMP '2024-01-11' OR ts >= TIMESTAMP '2024-01-21' GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_live_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of a stream behind a watermark of two hours; the late delivery is left out.

    The stream is stopped and taken up again after every delivery.
    """
    path, out, checkpoint = scratch(spark, "readings"), scratch(spark, "windows"), scratch(spark, "checkpoint")
    for part in _late_order(spark, d):
        _landed([part], path)
        live.run_view(live.live_windows(live.landed(spark, path, live.READING, 3)), out, checkpoint)
    found = spark.read.parquet(out).drop("ends_at")
    return rounded(found.withColumn("starts_at", F.col("starts_at").cast("timestamp_ntz")), "mean")


@query("""WITH b AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts >= TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch_id
  FROM events), k AS (SELECT batch_id, max(max(ts)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM b GROUP BY 1)
SELECT event_type AS gauge_id, count(*) AS late_rows FROM b JOIN k USING (batch_id)
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= newest - INTERVAL 2 HOUR GROUP BY 1""")
def live_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Readings that came too late for their live window."""
    parts = [part.withColumn("batch_id", F.lit(i)) for i, part in enumerate(_late_order(spark, d))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return live.late_rows(rows).groupBy("gauge_id").agg(F.count("*").alias("late_rows"))


@query("""SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'archive' ELSE 'table' END AS place,
  strftime(ts, '%Y-%m-%d') AS day, count(*) AS readings, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def retained_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings by day after the first half of January was exported, compared and released."""
    path, archive = scratch(spark, "dated"), scratch(spark, "archive")
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("gauge_id"), F.col("ts").cast("timestamp").alias("at"), "value", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    rows.write.partitionBy("day").parquet(path)
    call = (spark, path, archive, "january", live.READING, "day")
    retention.export(*call, "2024-01-15")
    retention.release(*call)
    kept = spark.read.schema(f"{live.READING}, day string").parquet(path).withColumn("place", F.lit("table"))
    moved = retention.exported(spark, archive, "january", live.READING, "day").withColumn("place", F.lit("archive"))
    found = kept.unionByName(moved).groupBy("place", "day").agg(F.count("*").alias("readings"), F.sum("value").alias("total"))
    return rounded(found, "total", digits=4)
