"""Compaction of stored batches into few files, with versions that readers switch to at once.

Batches leave a folder per parameter, month and batch, and one of marks each. ``compact`` writes
the batches of closed months again as files of a set size, and the marks as one row per series,
into folders of a new version. What a version holds is listed in its pointer, a table of its
own that is written last: readers follow the newest pointer that is complete, so they see the
state before or after, and a version that was cut short is never read. Batches that a pointer
names are no longer read; ``release`` deletes their folders once the readers of the version
before are done.

A late reading of a compacted month is a batch folder beside the version until the next run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.schemas import REVISION
from stagecast.sources.tables import read_parts, read_table

STORED = REVISION + ", event_month string, batch_id bigint"
MARKS = "source string, series_key string, event_time timestamp, batch_id bigint"
#: part: a month's folder, or MARKS_PART; version: where its rows are; batches: whose rows they are.
POINTER = "part string, version bigint, batches array<bigint>"
MARKS_PART = "high_water"
#: Bytes of a compacted file, about.
FILE_SIZE = 256 << 20


def _store(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _columns(spark: SparkSession) -> list[str]:
    return spark.createDataFrame([], STORED).columns


def _folders(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Names of the folders in a folder, with ``suffix`` only those that hold such a file."""
    store, at = _store(spark, path)
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
    done = lambda n: store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{suffix}"))
    return sorted(n for n in names if not suffix or done(n))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    return sorted(int(n.split("=")[1]) for n in _folders(spark, f"{root}/versions", "_SUCCESS"))


def pointer(spark: SparkSession, root: str) -> dict[str, tuple[int, list[int]]]:
    """For each compacted part its version and batches; a row per month and parameter."""
    known = versions(spark, root)
    if not known:
        return {}
    rows = spark.read.schema(POINTER).parquet(f"{root}/versions/v={known[-1]}").collect()
    return {r.part: (r.version, r.batches) for r in rows}


def stored_parts(spark: SparkSession, root: str, parts: list[str], skip: int | None = None) -> DataFrame:
    """Stored revisions of some months' folders (``parameter_code=../event_month=..``).

    Lists a month's compacted files and the batches since. Rows that batch ``skip`` left in a
    folder of its own are left out, since a replay will write them again.
    """
    current = pointer(spark, root)
    whole = [f"v={current[p][0]}/{p}" for p in parts if p in current]
    loose = []
    for p in parts:
        done = set(current[p][1]) if p in current else set()
        for name in _folders(spark, f"{root}/revisions/{p}"):
            batch = int(name.split("=")[1])
            if batch not in done and batch != skip:
                loose.append(f"{p}/{name}")
    columns = _columns(spark)
    found = read_parts(spark, f"{root}/revisions", loose, STORED).select(*columns)
    return found.unionByName(read_parts(spark, f"{root}/compacted", whole, STORED + ", v bigint").select(*columns))


def month_parts(spark: SparkSession, root: str) -> list[str]:
    """Folders of all months stored, by parameter; a month that was released stays in the pointer."""
    loose = [
        f"{p}/{m}" for p in _folders(spark, f"{root}/revisions") for m in _folders(spark, f"{root}/revisions/{p}")
    ]
    return sorted({*loose, *pointer(spark, root)} - {MARKS_PART})


def marks(spark: SparkSession, root: str) -> DataFrame:
    """Marks of all batches: rows of the compacted ones, then a row per series of each batch since."""
    version, batches = pointer(spark, root).get(MARKS_PART, (None, []))
    names = [n for n in _folders(spark, f"{root}/high_water", "_SUCCESS") if int(n.split("=")[1]) not in set(batches)]
    found = read_parts(spark, f"{root}/high_water", names, MARKS)
    if version is None:
        return found
    return found.unionByName(read_table(spark, f"{root}/compacted_marks/v={version}", MARKS, required=True))


def _sizes(rows: DataFrame) -> DataFrame:
    """Bytes of the files that some stored revisions lie in, by parameter and month."""
    files = rows.select("parameter_code", "event_month", "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy("parameter_code", "event_month").agg(F.sum("file_size").alias("bytes"))


def spread_months(rows: DataFrame, sizes: DataFrame, file_size: int) -> DataFrame:
    """Stored revisions dealt out so that a task holds what will be one file of one month.

    ``sizes`` has the bytes of each parameter and month. They are collected, a row per month like
    the pointer: joined as a query of unknown size, they would draw a month's rows into one task.
    """
    placed, first = [], 0
    for r in sizes.orderBy("parameter_code", "event_month").collect():
        files = max(1, -(-r.bytes // file_size))
        placed.append((r.parameter_code, r.event_month, files, first))
        first += files
    # from Arrow it is a local table of known size, which Spark broadcasts; from a list of rows it is not
    kinds = [("parameter_code", pa.string()), ("event_month", pa.string()), ("files", pa.int32()), ("first", pa.int32())]
    table = pa.table([pa.array(v, t) for v, (_, t) in zip(zip(*placed), kinds)], pa.schema(kinds))
    months = rows.sparkSession.createDataFrame(table)
    file = F.pmod(F.xxhash64("gauge_id", "event_time"), F.col("files")).cast("int")
    dealt = rows.join(months, ["parameter_code", "event_month"]).withColumn("file", F.col("first") + file)
    return dealt.repartitionById(max(1, first), "file").drop("file", "files", "first")


def compact(spark: SparkSession, root: str, open_months: int = 1, file_size: int = FILE_SIZE) -> int | None:
    """Write closed months and the marks anew; the new version, or None if there is nothing to do.

    The newest ``open_months`` months stay as they are. Only batches with marks count, which are
    the last that a batch writes. Months are spread over files by gauge and time, sorted by both,
    so a month with most of the rows is no single task.
    """
    current, known = pointer(spark, root), versions(spark, root)
    version = known[-1] + 1 if known else 1
    complete = {int(n.split("=")[1]) for n in _folders(spark, f"{root}/high_water", "_SUCCESS")}
    done_marks = set(current.get(MARKS_PART, (0, []))[1])
    complete |= done_marks
    parts = month_parts(spark, root)
    months = sorted({p.split("event_month=")[1] for p in parts})
    closed = set(months[: max(0, len(months) - open_months)])
    new, read = dict(current), []
    for p in parts:
        if p.split("event_month=")[1] not in closed:
            continue
        batches = {int(n.split("=")[1]) for n in _folders(spark, f"{root}/revisions/{p}")} & complete
        before = current[p][1] if p in current else []
        fresh = batches - set(before)
        if fresh:
            read += [(p, b) for b in sorted(fresh)]
            new[p] = (version, sorted({*before, *fresh}))
    columns = _columns(spark)
    if read:
        loose = read_parts(spark, f"{root}/revisions", [f"{p}/batch_id={b}" for p, b in read], STORED)
        old = [f"v={current[p][0]}/{p}" for p in sorted({p for p, _ in read}) if p in current]
        packed = read_parts(spark, f"{root}/compacted", old, STORED + ", v bigint")
        sizes = _sizes(loose)
        if old:
            sizes = sizes.unionByName(_sizes(packed)).groupBy("parameter_code", "event_month").agg(F.sum("bytes").alias("bytes"))
        rows = loose.select(*columns).unionByName(packed.select(*columns))
        (
            spread_months(rows, sizes, file_size)
            .sortWithinPartitions("parameter_code", "event_month", "gauge_id", "event_time")
            .write.mode("overwrite")
            .partitionBy("parameter_code", "event_month")
            .parquet(f"{root}/compacted/v={version}")
        )
    if complete - done_marks:
        # the batch of a series' row is the newest one that marked it
        folded = marks(spark, root).groupBy("source", "series_key").agg(F.max("event_time").alias("event_time"), F.max("batch_id").alias("batch_id"))
        folded.write.mode("overwrite").parquet(f"{root}/compacted_marks/v={version}")
        new[MARKS_PART] = (version, sorted(complete))
    if new == current:
        return None
    listed = [(part, v, batches) for part, (v, batches) in sorted(new.items())]
    spark.createDataFrame(listed, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/v={version}")
    return version


def release(spark: SparkSession, root: str) -> int:
    """Delete the batch folders that the current version has taken over, and older versions' files.

    To be run when no reader of an older version is left. Returns the number of folders deleted.
    """
    current, gone = pointer(spark, root), 0
    for part, (version, batches) in current.items():
        base = f"{root}/high_water" if part == MARKS_PART else f"{root}/revisions/{part}"
        old = [f"{base}/{n}" for n in _folders(spark, base) if int(n.split("=")[1]) in set(batches)]
        where = f"{root}/compacted_marks" if part == MARKS_PART else f"{root}/compacted"
        inside = "" if part == MARKS_PART else f"/{part}"
        for name in _folders(spark, where):
            path = f"{where}/{name}{inside}"
            store, at = _store(spark, path)
            if int(name.split("=")[1]) < version and store.exists(at):
                old.append(path)
        for path in old:
            store, at = _store(spark, path)
            store.delete(at, True)
        gone += len(old)
    return gone
