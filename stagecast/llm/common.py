"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from secrets import randbelow

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query of this package under its function's name."""

    def register(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches of the session small: rows here hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def whole_text(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(ident: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns (rid, rhash) that tell rows apart by id and text; equal rows share a key."""
    return [F.col(ident).alias("rid"), F.xxhash64(whole_text(text)).alias("rhash")]


def keyed_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (rid, rhash), null ids included; the right side's key is dropped."""
    right = right.withColumnsRenamed({"rid": "other_rid", "rhash": "other_rhash"})
    same = F.col("rid").eqNullSafe(F.col("other_rid")) & (F.col("rhash") == F.col("other_rhash"))
    return left.join(right, same, how).drop("other_rid", "other_rhash")


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``most``; a larger row is a range of its own."""
    start, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + most, side="right"))
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its row boundaries in them."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw, bounds - bounds[0]


def text_slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``most`` bytes of text each, their bytes and row boundaries."""
    column = batch.column(name)
    raw, bounds = utf8(column)
    for start, stop in cuts(np.diff(bounds), most):
        rows = batch.slice(start, stop - start)
        yield rows, raw[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column of stretches of ``values``."""
    whole = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values))
    return whole.cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values (multiply and xor-shift), one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


PRIME = (1 << 31) - 1


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.ones(1, dtype=np.uint64)
    while len(powers) < n:
        step = np.uint64(pow(base, len(powers), PRIME))
        powers = np.concatenate([powers, powers * step % np.uint64(PRIME)])
    return powers


class SpanHashes:
    """Polynomial hashes of spans modulo the prime 2**31 - 1, at two bases drawn at random.

    Two different spans of n values collide at a random base with a chance of n / 2**31 at
    most, whatever the values are; modulo 2**64 there are words that collide at every base.
    An object sent to tasks takes its bases along, so hashes agree over all tasks of a job.
    """

    def __init__(self):
        self.bases = [256 + randbelow(PRIME - 512) for _ in range(2)]
        self.powers = []

    def __getstate__(self):
        return {"bases": self.bases, "powers": []}

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.powers or len(self.powers[0][0]) <= n:
            self.powers = [(_powers(b, n + 1), _powers(pow(b, -1, PRIME), n + 1)) for b in self.bases]
        return self.powers

    def of(self, values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span [start, stop) of ``values``, equal for equal spans.

        Each base sees 31 bits of a value: values below 2**31 - 1 are seen whole by both,
        others (hashes) by halves.
        """
        p, shift = np.uint64(PRIME), np.uint64(31)
        wide = values.dtype.itemsize == 8
        parts = []
        for lane, (up, down) in enumerate(self.upto(len(values))):
            own = (values >> shift if lane else values) & p if wide else values + np.uint64(1)
            own = own * up[: len(values)]
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum((own & p) + (own >> shift), out=sums[1:])
            parts.append((sums[stops] - sums[starts]) % p * down[starts] % p)
        return parts[0] << shift | parts[1]


def is_space() -> np.ndarray:
    """Whether a byte separates words: space and the controls 9 to 13."""
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words in ``raw``, and the row's word boundaries (len(bounds))."""
    inside = ~is_space()[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return starts, stops, np.searchsorted(starts, bounds)
