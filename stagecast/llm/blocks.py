"""Blocks of consecutive ids, for work in id order without a window over all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks per shuffle partition, and ids sampled per block to find their limits.
BLOCKS, SAMPLED = 4, 32


def limits(ids: DataFrame, name: str, blocks: int) -> np.ndarray:
    """Ids that limit the blocks, ascending: out of a sample, with the smallest and largest id.

    Their number is bounded by the number of blocks, which follows the shuffle partitions.
    """
    known = ids.select(F.col(name).cast("long").alias("id")).filter("id is not null")
    n, low, top = known.agg(F.count("id"), F.min("id"), F.max("id")).first()
    if not n:
        return np.zeros(0, dtype=np.int64)
    share = min(1.0, SAMPLED * blocks / n)
    some = known.sample(share, seed=11) if share < 1 else known
    some = np.sort(some.toPandas()["id"].to_numpy())
    return np.unique(np.concatenate([some[:: max(1, len(some) // blocks)], [low, top]]))


def in_blocks(rows: DataFrame, name: str, descending: bool = False, heads: bool = False) -> DataFrame:
    """``rows`` with block and copy, dealt to partitions by block; each block is in one partition.

    Blocks are numbered in the order of the id (a whole number) and hold consecutive ids; equal
    ids share a block. Null ids come first, or last where descending. With ``heads`` the rows
    of a block's first id are copied to the end of the block before it, those of the first
    block to the last one; copies have copy = true.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(limits(rows.select(name), name, BLOCKS * n))

    @F.pandas_udf("array<struct<block:int,copy:boolean>>")
    def place(ids: pd.Series) -> pd.Series:
        asc = sent.value
        last = max(len(asc) - 1, 0)
        known = ids.notna().to_numpy()
        value = ids.where(known, 0).to_numpy(dtype=np.int64)
        if descending:
            at = np.searchsorted(asc, value, side="left")
            own = np.where(known, last - at, last)
        else:
            at = np.searchsorted(asc, value, side="right") - 1
            own = np.where(known, at, 0)
        opens = known & heads & (at >= 0) & (at < len(asc))
        opens[opens] = asc[at[opens]] == value[opens]
        before = np.where(own == 0, last, own - 1)
        return pd.Series(
            [[(o, False), (p, True)] if c else [(o, False)] for o, c, p in zip(own.tolist(), opens, before.tolist())]
        )

    rows = rows.withColumn("at", F.explode(place(F.col(name).cast("long"))))
    return rows.select("*", "at.*").drop("at").repartition(n, "block")
