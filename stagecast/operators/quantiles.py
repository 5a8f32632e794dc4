"""Exact quantiles of groups of any size.

``percentile`` gathers every distinct value of a group in one task. Here a first pass counts
values per coarse bin, which finds the bin of each wanted rank; a second pass counts distinct
values in those bins only. Sums of counts are all that is ordered per group, so a group holding
a third of all rows needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUB_BINS = 4096


def _coarse(value: Column) -> Column:
    """A rising step function of the value: 64 bins per doubling, linear near zero."""
    return F.floor(F.signum(value) * F.log2(F.lit(1.0) + F.abs(value) * 1024.0) * 64.0)


def _locate(counts: DataFrame, keys: Sequence[str], bucket: str, wanted: DataFrame) -> DataFrame:
    """Bucket holding each wanted rank, and the rank counted from that bucket's first value."""
    running = Window.partitionBy(*keys).orderBy(bucket)
    spans = counts.withColumn("through", F.sum("n").over(running)).withColumn(
        "upto", F.col("through") - F.col("n")
    )
    return (
        wanted.join(spans, list(keys))
        .where((F.col("rank") >= F.col("upto")) & (F.col("rank") < F.col("through")))
        .withColumn("rank", F.col("rank") - F.col("upto"))
        .drop("n", "through", "upto")
    )


def _wanted_bins(bins: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Bins that hold a wanted rank, a row per rank, counted from the bin's first value."""
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    spans = bins.withColumns(
        {
            "through": F.sum("n").over(by_bin),
            "group_size": F.sum("n").over(Window.partitionBy(*keys)),
        }
    ).withColumn("upto", F.col("through") - F.col("n"))
    wanted = []
    for p in probabilities:
        exact = F.lit(float(p)) * (F.col("group_size") - 1)
        for rank in (F.floor(exact), F.ceil(exact)):
            wanted.append(
                F.struct(
                    F.lit(float(p)).alias("probability"),
                    exact.alias("exact"),
                    rank.cast("bigint").alias("rank"),
                )
            )
    inside = F.filter(
        F.array_distinct(F.array(*wanted)),
        lambda w: (w["rank"] >= F.col("upto")) & (w["rank"] < F.col("through")),
    )
    return spans.select(
        *keys, "bin", "lo", "hi", "group_size", "upto", F.inline(inside)
    ).withColumn("rank", F.col("rank") - F.col("upto")).drop("upto")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """One row per group and probability: keys, ``probability``, ``quantile``, ``group_size``.

    Linear interpolation between the two closest ranks. Nulls are left out.
    """
    keys = list(keys)
    rows = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("v"))
        .withColumn("bin", _coarse(F.col("v")))
    )
    bins = rows.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    in_bin = _wanted_bins(bins, keys, probabilities)
    # values of the wanted bins, counted by value; sub-bins keep each ordered group small
    ranges = in_bin.select(*keys, "bin", "lo", "hi").distinct()
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    values = (
        rows.join(ranges, [*keys, "bin"])
        .withColumn(
            "sub",
            F.when(F.col("hi") > F.col("lo"), F.floor(share * _SUB_BINS)).otherwise(0),
        )
        .groupBy(*keys, "bin", "sub", "v")
        .agg(F.count("*").alias("n"))
    )
    subs = values.groupBy(*keys, "bin", "sub").agg(F.sum("n").alias("n"))
    in_sub = _locate(subs, [*keys, "bin"], "sub", in_bin.drop("lo", "hi"))
    held = in_sub.select(*keys, "bin", "sub").distinct()  # only values of these sub-bins are put in order
    picked = _locate(values.join(held, [*keys, "bin", "sub"], "left_semi"), [*keys, "bin", "sub"], "v", in_sub)
    fraction = F.col("exact") - F.floor("exact")
    return (
        picked.groupBy(*keys, "probability", "group_size")
        .agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.max("exact").alias("exact")
        )
        .select(
            *keys,
            "probability",
            (F.col("low") + fraction * (F.col("high") - F.col("low"))).alias("quantile"),
            "group_size",
        )
    )


def quantile_columns(
    df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]
) -> DataFrame:
    """The same, one row per group with a column per named probability."""
    long = exact_quantiles(df, keys, value, list(named.values()))
    columns = [
        F.max(F.when(F.col("probability") == F.lit(float(p)), F.col("quantile"))).alias(name)
        for name, p in named.items()
    ]
    return long.groupBy(*keys).agg(*columns)
