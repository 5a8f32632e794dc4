"""Tables as Parquet: revisions, forecasts, reports, frozen manifests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.constants import SPLITS
from stagecast.operators.revisions import latest_by


class FrozenInputChanged(ValueError):
    pass


class MissingTable(ValueError):
    pass


def read_table(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A table, or no rows while its folder does not exist; a required one has to be there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if required:
            raise MissingTable(f"no table at {path}") from error
        return _no_rows(spark, schema)


def _no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that Spark knows to be empty, so that a join with it shuffles nothing."""
    return spark.createDataFrame([], schema).limit(0)


def read_parts(spark: SparkSession, path: str, parts: Sequence[str], schema: str) -> DataFrame:
    """Some partitions of a table, named by their folders; no others are listed."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    store = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    there = [f"{path}/{p}" for p in parts if store.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{p}"))]
    if not there:
        return _no_rows(spark, schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*there)


def with_month(revisions: DataFrame) -> DataFrame:
    return revisions.withColumn("event_month", F.date_format("event_time", "yyyy-MM"))


def merge_forecasts(stored: DataFrame, issued: DataFrame) -> DataFrame:
    """Upsert by id: the issued row replaces a stored one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(issued.withColumn("_new", F.lit(1)))
    return latest_by(both, ["id"], F.col("_new").desc(), F.col("issued_at").desc()).drop("_new")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free hash of a table, one row."""
    row = F.xxhash64(*[F.to_json(F.struct(*df.columns))])
    return df.agg(
        F.count("*").alias("rows"),
        F.concat_ws(
            "-",
            F.count("*"),
            F.coalesce(F.bit_xor(row), F.lit(0)),
            F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)),
        ).alias("fingerprint"),
    )


def manifest(
    upstream: DataFrame, inputs: dict[str, DataFrame], cutoff: date, splits=SPLITS
) -> DataFrame:
    """What model work must not change: splits, input fingerprints and suitable lags.

    Upstream rows are ``(target_id, gauge_id, lag_hours, suitable)``. Columns: section, name,
    detail, number.
    """
    spark = upstream.sparkSession
    fixed = [
        ("split", name, f"{first.isoformat()}/{(last or cutoff).isoformat()}", None)
        for name, first, last in splits
    ] + [("archive_cutoff", "archive_cutoff", cutoff.isoformat(), None)]
    schema = "section string, name string, detail string, number bigint"
    rows = spark.createDataFrame(fixed, schema)
    for name, df in inputs.items():
        rows = rows.unionByName(
            fingerprint(df).select(
                F.lit("input").alias("section"),
                F.lit(name).alias("name"),
                F.col("fingerprint").alias("detail"),
                F.col("rows").alias("number"),
            )
        )
    lags = upstream.where("suitable").select(
        F.lit("lag").alias("section"),
        F.col("target_id").alias("name"),
        F.col("gauge_id").alias("detail"),
        F.col("lag_hours").cast("bigint").alias("number"),
    )
    return rows.unionByName(lags)


def freeze(manifest_rows: DataFrame, path: str) -> None:
    """Write once; a second freeze fails."""
    manifest_rows.write.mode("errorifexists").parquet(path)


def frozen_lags(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.where(F.col("section") == "lag").select(
        F.col("name").alias("target_id"),
        F.col("detail").alias("gauge_id"),
        F.col("number").alias("lag_hours"),
    )


def require_unchanged(manifest_rows: DataFrame, name: str, df: DataFrame) -> None:
    """Refuse an input whose content differs from the frozen one."""
    frozen = (
        manifest_rows.where((F.col("section") == "input") & (F.col("name") == name))
        .select("detail")
        .first()
    )
    if frozen is None or frozen.detail != fingerprint(df).first().fingerprint:
        raise FrozenInputChanged(f"input {name} changed after the manifest was frozen")


def require_cutoff(manifest_rows: DataFrame, cutoff: date) -> None:
    """Refuse work up to another day than the frozen one."""
    frozen = manifest_rows.where(F.col("section") == "archive_cutoff").select("detail").first()
    if frozen is None or frozen.detail != cutoff.isoformat():
        raise FrozenInputChanged(f"the manifest is not frozen at {cutoff.isoformat()}")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Feature sets and reports: Parquet by target or report key."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def challenger_records(scored: DataFrame) -> DataFrame:
    """Nested records of rows ``(target_id, issued_at, input_ends, model, horizon, quantile, value)``:
    horizon to quantile to value, append-only by issue time."""
    by_horizon = scored.groupBy("target_id", "issued_at", "input_ends", "model", "horizon").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("quantile").cast("string"), "value")))
        ).alias("quantiles")
    )
    return (
        by_horizon.groupBy("target_id", "issued_at", "input_ends", "model")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("horizon", "quantiles"))
            ).alias("stage_quantiles_ft")
        )
        .withColumn("model_status", F.lit("challenger_shadow"))
    )
