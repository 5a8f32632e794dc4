"""Ordered work on long series, spread over blocks of the ordering axis.

A window over one gauge runs in one task, however long the gauge's series. Here the axis (epoch
microseconds, a step index or a sequence number) is cut into blocks of fixed width and the
window runs per (key, block), so a key holding a third of all rows still spreads over many
tasks. Two ways put the pieces together again:

* ``with_blocks`` copies a row into neighbouring blocks that can see it, which is enough for any
  frame of bounded reach;
* ``before_block`` carries sums, maxima or last values over a table with a row or so per block.

A block should hold roughly 1e3 to 1e5 rows of one key: wide enough that copies and the
per-block table stay small, narrow enough for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_start(position: Column, width: int) -> Column:
    return position - F.pmod(position, F.lit(width).cast("bigint"))


def with_blocks(
    df: DataFrame, position: str, width: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Add ``block`` and ``home``.

    A row appears once in its own block (``home``) and once in every block holding a row that
    looks back at most ``before`` or ahead at most ``after`` and so can see it.
    """
    at = F.col(position)
    own = block_start(at, width)
    if not before and not after:
        return df.withColumn("block", own).withColumn("home", F.lit(True))
    blocks = F.sequence(
        block_start(at - after, width),
        block_start(at + before, width),
        F.lit(width).cast("bigint"),
    )
    return df.withColumn("block", F.explode(blocks)).withColumn("home", F.col("block") == own)


def in_block(keys: Sequence[str], *order: str) -> Window:
    return Window.partitionBy(*keys, "block").orderBy(*order)


def before_block(
    per_block: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    lasts: Sequence[str] = (),
    order: Sequence[str] = ("block",),
) -> DataFrame:
    """Replace columns of a per-block table by their running value over earlier rows of the key."""
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    changed = {name: F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in sums}
    changed |= {name: F.max(name).over(earlier) for name in maxima}
    changed |= {name: F.last(name, ignorenulls=True).over(earlier) for name in lasts}
    return per_block.select(
        *[changed[name].alias(name) if name in changed else name for name in per_block.columns]
    )


def numbered(df: DataFrame, keys: Sequence[str], position: str, width: int) -> DataFrame:
    """Add ``row_index``: 0-based position of each row within its key, ordered by ``position``."""
    blocked = with_blocks(df, position, width).drop("home")
    local = blocked.withColumn("row_index", F.row_number().over(in_block(keys, position)) - 1)
    counts = before_block(
        blocked.groupBy(*keys, "block").agg(F.count("*").alias("earlier")), keys, sums=["earlier"]
    )
    return (
        local.join(counts, [*keys, "block"])
        .withColumn("row_index", F.col("row_index") + F.col("earlier"))
        .drop("earlier", "block")
    )


def every_nth(df: DataFrame, keys: Sequence[str], position: str, n: int, width: int) -> DataFrame:
    """Strided thinning: rows 0, n, 2n, ... of each key in order."""
    return numbered(df, keys, position, width).where(F.col("row_index") % n == 0).drop("row_index")
