"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits. Its embedding is the vector of the
segments' bit counts, written in unary (0, 1, 2 as 00, 01, 11), so that the Manhattan
distance of two vectors is the number of differing bits of their codes and a lower bound of
the fingerprints' Hamming distance. The vector space is laid out as a grid over six groups of
segments. Two vectors within distance 3 agree in three of the groups at least, so they meet
in one of the 20 cells that three groups each name. Within a cell the Manhattan distance is
tested first and the Hamming distance after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import query, row_key, small_batches, table, whole_text
from stagecast.llm.graph import components
from stagecast.session import materialise

SHINGLE, SEED, RADIUS = 3, 42, 3
GROUPS = (6, 6, 5, 5, 5, 5)
#: Fingerprints compared with one another at once; larger cells are refined, then tiled.
TILE = 2048

LOW = 0x5555555555555555


def _masks() -> list[int]:
    """One mask of the code's bits for every choice of all but RADIUS groups."""
    groups, at = [], 0
    for n in GROUPS:
        groups.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    kept = len(GROUPS) - RADIUS
    return [sum(chosen) for chosen in combinations(groups, kept)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text: a bit is set if set in over half its shingles' hashes.

    Words are runs of anything but space and the controls 9 to 13, with A-Z in lower case;
    a shingle is three words joined by a space. Fewer words give one shingle, none give 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n], stops)], dtype=">u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        part = np.unpackbits(hashes[i : i + 65536].view(np.uint8)).reshape(-1, 64)
        set_bits += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
        yield batch.drop_columns(["text"]).append_column("fp", pa.array(found, pa.int64()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(rid, rhash, fp) of every row of documents (doc_id, text); fp as a signed long.

    Null texts count as empty; empty texts have fingerprint 0; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*row_key(), whole_text().alias("text"))
    return rows.mapInArrow(_fingerprints, f"rid {kind}, rhash long, fp long")


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def linked_in_cells(fps: np.ndarray, codes: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smallest linked fp) inside the cells; ``cell`` numbers are sorted."""
    left, right = [], []
    at, lag = np.arange(len(fps) - 1), 1
    while len(at):
        at = at[at + lag < len(fps)]
        at = at[cell[at] == cell[at + lag]]
        near = at[np.bitwise_count(codes[at] ^ codes[at + lag]) <= RADIUS]
        near = near[np.bitwise_count(fps[near] ^ fps[near + lag]) <= RADIUS]
        left.append(near)
        right.append(near + lag)
        lag += 1
    if not left:
        return fps[:0], fps[:0]
    first = smallest_linked(len(fps), np.concatenate(left), np.concatenate(right))
    moved = np.nonzero(first != np.arange(len(fps)))[0]
    return fps[moved], fps[first[moved]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each cell; rows come sorted by cell and a cell has few rows."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).combine_chunks()
        rest = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        while rest.num_rows > 4 * TILE:
            rest, done = _done(rest)
            if done is None:
                break
            yield done
    if rest is not None and rest.num_rows:
        yield _linked(rest)


def _numbers(rows: pa.Table) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    for name in ("combo", "level", "cell", "tile"):
        values = rows.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _done(rows: pa.Table):
    numbers = _numbers(rows)
    last = int(np.searchsorted(numbers, numbers[-1]))
    return (rows, None) if last == 0 else (rows.slice(last), _linked(rows.slice(0, last)))


def _linked(rows: pa.Table) -> pa.RecordBatch:
    fps = rows.column("fp").to_numpy().view(np.uint64)
    a, b = linked_in_cells(fps, rows.column("code").to_numpy().view(np.uint64), _numbers(rows))
    return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) linked at RADIUS bits or fewer.

    All pairs of a cell are compared, but each connected part of a cell is returned as a star.
    A cell with over TILE members is cut by the exact bits of its three groups (pairs that
    agree in three groups agree in their bits as well); one that is still larger is compared
    tile by tile, so no task holds more than two tiles of it.
    """
    both = F.shiftrightunsigned("fp", 1).bitwiseAND(F.col("fp")).bitwiseAND(F.lit(LOW))
    any_ = F.shiftrightunsigned("fp", 1).bitwiseOR(F.col("fp")).bitwiseAND(F.lit(LOW))
    code = any_.bitwiseOR(F.shiftleft(both, 1))
    masks = F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(_masks())])
    keys = fps.select("fp", code.alias("code"), F.explode(masks).alias("m"))
    keys = keys.select("fp", "code", "m.*").withColumn("coarse", F.col("code").bitwiseAND(F.col("mask")))

    def crowded(rows: DataFrame, cell: str, label: str) -> DataFrame:
        n = rows.groupBy("combo", cell).agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
        return materialise(n, label)

    hot = crowded(keys, "coarse", "crowded").withColumnRenamed("n", "n1")
    keys = keys.join(hot, ["combo", "coarse"], "left")
    level = F.when(F.col("n1").isNull(), 0).otherwise(1)
    cell = F.when(F.col("n1").isNull(), F.col("coarse")).otherwise(F.col("fp").bitwiseAND(F.col("mask")))
    keys = keys.select("fp", "code", "combo", level.alias("level"), cell.alias("cell"))
    hotter = crowded(keys.filter("level = 1"), "cell", "still-crowded").withColumn("level", F.lit(1))
    keys = keys.join(hotter, ["combo", "level", "cell"], "left")
    parts = F.ceil(F.col("n") * 2 / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts)
    tiles = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda k: F.least(own, k.cast("long")) * F.lit(1 << 20) + F.greatest(own, k.cast("long")),
    )
    keys = keys.withColumn("tile", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(tiles)))
    by = ["combo", "level", "cell", "tile"]
    keys = keys.select("fp", "code", *by)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_cells, "a long, b long")


def groups(rows: DataFrame) -> DataFrame:
    """(fp, component, component_id) from (rid, fp): the smallest fingerprint and id reachable over links.

    Ids that are null count only where a component has no other. As ids may repeat, it is
    ``component`` that tells groups apart.
    """
    smallest = rows.groupBy("fp").agg(F.min("rid").alias("rid"))
    smallest = materialise(smallest, "fingerprints")
    linked = components(links(smallest.select("fp")))
    named = smallest.join(linked, smallest["fp"] == linked["node"], "left")
    named = named.select("fp", "rid", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rid").alias("component_id"))
    return materialise(named.join(ids, "component").select("fp", "component", "component_id"), "groups")


def near_copies(docs: DataFrame) -> DataFrame:
    """(rid, rhash, fp, component, component_id) of every row; see ``fingerprints``, ``groups``."""
    rows = materialise(fingerprints(docs), "simhash")
    return rows.join(groups(rows), "fp")


@query()
def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document of ``documents``."""
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("rid").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
