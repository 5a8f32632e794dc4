"""Old partitions of a dated table: copied to an archive, compared, and only then released.

An export is a folder of its own: the copy, and a manifest of rows and digest of each partition,
written last and only if the copy, read back, agrees with the table. ``release`` compares both
again with the manifest and deletes a partition only where all three agree, so neither a damaged
copy nor rows that came after the export lose anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.sources.tables import read_table

SAME = ("rows", "digest")


class DamagedCopy(ValueError):
    pass


def partition_digests(rows: DataFrame, by: str) -> DataFrame:
    """Rows and digest of each partition; order and files do not matter, repeated rows do.

    One aggregation, combined before the shuffle to a row per task and partition.
    """
    text = F.to_json(F.struct(*sorted(c for c in rows.columns if c != by)))
    row = F.xxhash64(text)
    total = F.sum(row.cast("decimal(38,0)"))
    return rows.groupBy(by).agg(
        F.count("*").alias("rows"), F.concat_ws("-", F.bit_xor(row), total, F.sum(F.length(text))).alias("digest")
    )


def _manifest_schema(by: str) -> str:
    return f"{by} string, rows bigint, digest string"


def exported(spark: SparkSession, archive: str, name: str, schema: str, by: str) -> DataFrame:
    """The copied rows of an export."""
    return read_table(spark, f"{archive}/{name}/data", f"{schema}, {by} string")


def manifest_of(spark: SparkSession, archive: str, name: str, by: str) -> DataFrame:
    """Rows and digest of each exported partition; an error where the export is not complete."""
    return read_table(spark, f"{archive}/{name}/manifest", _manifest_schema(by), required=True)


def export(spark: SparkSession, path: str, archive: str, name: str, schema: str, by: str, before: str) -> DataFrame:
    """Copy the partitions whose ``by`` is below ``before``; their manifest.

    ``schema`` are the table's columns without ``by``, a string. Tasks write what they read, so
    nothing is shuffled but the digests. An export of that name must not exist; one cut short has
    no manifest and is repeated under another name.
    """
    rows = read_table(spark, path, f"{schema}, {by} string").where(F.col(by) < before)
    rows.write.mode("errorifexists").partitionBy(by).parquet(f"{archive}/{name}/data")
    copied = partition_digests(exported(spark, archive, name, schema, by), by)
    differing = partition_digests(rows, by).exceptAll(copied).select(by).limit(20).collect()
    if differing:
        raise DamagedCopy("the copy differs in " + ", ".join(sorted(str(r[0]) for r in differing)))
    copied.coalesce(1).write.mode("errorifexists").parquet(f"{archive}/{name}/manifest")
    return manifest_of(spark, archive, name, by)


def comparison(spark: SparkSession, path: str, archive: str, name: str, schema: str, by: str) -> DataFrame:
    """Each partition of an export with what may be done: ``release``, or why not.

    ``gone`` is one released before, ``damaged copy`` one whose copy is not what the manifest
    says, ``changed since`` one that holds other rows than were exported.
    """
    listed = manifest_of(spark, archive, name, by)
    dates = [r[0] for r in listed.select(by).collect()]  # partitions, not rows
    live = read_table(spark, path, f"{schema}, {by} string").where(F.col(by).isin(dates))

    def now(rows: DataFrame, side: str) -> DataFrame:
        return partition_digests(rows, by).select(by, F.struct(*SAME).alias(side))

    both = (
        listed.select(by, F.struct(*SAME).alias("said"))
        .join(now(exported(spark, archive, name, schema, by), "copied"), by, "left")
        .join(now(live, "kept"), by, "left")
    )
    whole = F.col("copied").eqNullSafe(F.col("said"))
    status = (
        F.when(~whole, "damaged copy")
        .when(F.col("kept").isNull(), "gone")
        .when(F.col("kept") != F.col("said"), "changed since")
        .otherwise("release")
    )
    return both.select(by, F.col("said.rows").alias("rows"), status.alias("status"))


def release(spark: SparkSession, path: str, archive: str, name: str, schema: str, by: str) -> dict[str, str]:
    """Delete the partitions that agree with their copy; what was found of each.

    To be run while nothing writes to these partitions.
    """
    found = {r[0]: r.status for r in comparison(spark, path, archive, name, schema, by).collect()}
    for value, status in found.items():
        if status == "release":
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return found
