"""Embedding near-dedup: random-hyperplane hashing in several tables, verified exactly.

Vectors are compared within their label only. Equal vectors form a class and travel as one.
Each table hashes a class to the signs of BITS random projections; classes that meet in a
bucket of any table are compared by cosine in double precision. A pair that meets in several
tables counts in the first one. Linked classes are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import query, table
from stagecast.llm.graph import components
from stagecast.llm.simhash import smallest_linked
from stagecast.session import materialise

THRESHOLD = 0.93
#: At the threshold a pair meets in a table with probability 0.88 ** BITS = 0.25, in one of all
#: tables with 0.999.
TABLES, BITS, SEED = 24, 11, 5
#: Classes compared with one another at once; larger buckets are compared tile by tile.
TILE = 1024
#: Rows of a bucket up to which it is compared together with others.
SMALL = 32


@lru_cache(maxsize=8)
def planes(size: int) -> np.ndarray:
    """The hyperplanes for vectors of a size, the same in every worker."""
    return np.random.default_rng([SEED, size]).normal(size=(size, TABLES * BITS))


def signatures(vectors: np.ndarray) -> np.ndarray:
    """One bucket number per row and table."""
    signs = (vectors @ planes(vectors.shape[1]) > 0).reshape(len(vectors), TABLES, BITS)
    return (signs @ (1 << np.arange(BITS))).astype(np.int32)


def _vectors(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array(batch.column("size"))
        for size in np.unique(sizes):
            rows = batch.filter(pa.array(sizes == size))
            found = signatures(_vectors(rows.column("vector"), int(size)))
            flat = pa.array(found.reshape(-1), pa.int32())
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * TABLES)
            yield rows.append_column("buckets", pa.ListArray.from_arrays(ends, flat))


def usable(embedding: str = "embedding", label: str = "label"):
    """Whether a row can link at all: a label, and a vector of finite numbers that isn't zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col(embedding).cast("array<double>")
    ok = F.col(label).isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """(rep, label, vector, size, members): distinct vectors of a label, named by their smallest id."""
    found = rows.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    return found.withColumn("size", F.size("vector"))


KEY = ("label", "size", "tab", "bucket", "tile")


def _pairs(vectors: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell at THRESHOLD or above; ``cell`` numbers are sorted.

    Small cells are compared all at once, row against the row d places on; large ones one by
    one with a matrix product.
    """
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    heads = np.nonzero(np.diff(cell, prepend=-1))[0]
    sizes = np.diff(np.append(heads, len(cell)))
    left, right = [], []
    for head, size in zip(heads[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        part, norm = vectors[head : head + size], norms[head : head + size]
        i, j = np.nonzero(np.triu((part @ part.T) / np.outer(norm, norm) >= THRESHOLD, 1))
        left.append(i + head)
        right.append(j + head)
    at, lag = np.nonzero(np.repeat(sizes, sizes) <= SMALL)[0], 1
    while len(at):
        at = at[at + lag < len(cell)]
        at = at[cell[at] == cell[at + lag]]
        cosine = np.einsum("ij,ij->i", vectors[at], vectors[at + lag]) / (norms[at] * norms[at + lag])
        near = at[cosine >= THRESHOLD]
        left.append(near)
        right.append(near + lag)
        lag += 1
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left + none), np.concatenate(right + none)


def compared(rows: pa.Table) -> pa.RecordBatch:
    """(rep, low, links) of the classes of whole buckets or tiles, of vectors of one size.

    ``low`` is the smallest class reached inside the tile, ``links`` the vectors linked there; a
    pair counts in the first table in which it meets, and in one tile of a bucket.
    """
    change = np.zeros(rows.num_rows, dtype=bool)
    for name in KEY:
        values = rows.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    a, b = _pairs(_vectors(rows.column("vector"), rows.column("size")[0].as_py()), np.cumsum(change))
    rep, members = rows.column("rep").to_numpy(), rows.column("members").to_numpy()
    buckets = rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
    tab, chunk, tile = (rows.column(c).to_numpy() for c in ("tab", "chunk", "tile"))
    earlier = np.arange(TABLES) < tab[a][:, None]
    first = ~np.any((buckets[a] == buckets[b]) & earlier, axis=1)
    # pairs inside a chunk belong to the chunk's own tile
    first &= (tile[a] >> 20 == tile[a] & ((1 << 20) - 1)) | (chunk[a] != chunk[b])
    links = np.zeros(len(rep), dtype=np.int64)
    np.add.at(links, a[first], members[b[first]])
    np.add.at(links, b[first], members[a[first]])
    low = smallest_linked(len(rep), a, b)
    keep = (links > 0) | (low != np.arange(len(rep)))
    return pa.record_batch({"rep": rep[keep], "low": rep[low[keep]], "links": links[keep]})


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by KEY; those of the last bucket wait for the next batch."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = (part if rest is None else pa.concat_tables([rest, part])).combine_chunks()
        last = np.ones(rest.num_rows, dtype=bool)
        for name in KEY:
            values = rest.column(name).to_numpy()
            last &= values == values[-1]
        yield from _by_size(rest.slice(0, int(np.argmax(last))))
        rest = rest.slice(int(np.argmax(last)))
    if rest is not None:
        yield from _by_size(rest)


def _by_size(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    sizes = rows.column("size").to_numpy()
    for size in np.unique(sizes):
        yield compared(rows.filter(pa.array(sizes == size)).combine_chunks())


def links(found: DataFrame) -> DataFrame:
    """(rep, low, links) from classes; rows of a class add up to its links to other classes.

    Buckets of over TILE classes are dealt to chunks, and each pair of chunks is a tile; this
    takes work with the square of the bucket, but no task holds more than two chunks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    hashed = materialise(
        found.mapInArrow(_hash, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", buckets array<int>"), "hashed"
    )
    slim = hashed.select("label", "size", F.posexplode("buckets").alias("tab", "bucket"))
    crowded = slim.groupBy("label", "size", "tab", "bucket").agg(F.count("*").alias("n"))
    crowded = materialise(crowded.filter(F.col("n") > TILE), "crowded")
    rows = hashed.select("*", F.posexplode("buckets").alias("tab", "bucket"))
    rows = rows.join(crowded, ["label", "size", "tab", "bucket"], "left")
    parts = F.coalesce(F.ceil(F.col("n") * 2 / TILE), F.lit(1)).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    rows = rows.withColumn(
        "tile", F.least("chunk", "other").cast("long") * F.lit(1 << 20) + F.greatest("chunk", "other").cast("long")
    ).drop("n", "other")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *KEY).sortWithinPartitions(*KEY)
    return rows.mapInArrow(_buckets, f"rep {kinds['rep']}, low {kinds['rep']}, links long")


def near_copies(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Null, zero and non-finite vectors and vectors without a label have no links and are their
    own component; vectors of different sizes never link. Repeated rows are different vectors
    of one class. An empty table gives an empty table.
    """
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select("vec_id", "label", F.when(usable(), vector).alias("vector"))
    found = materialise(classes(rows.filter("vector is not null")), "classes")
    near = materialise(links(found), "near")
    counts = near.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(near.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    named = (
        found.join(counts, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("class_label"),
            F.col("vector").alias("class_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    named = materialise(named, "named")
    same = (F.col("label") == F.col("class_label")) & (F.col("vector") == F.col("class_vector"))
    joined = rows.join(named, same, "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


NEAR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in e])
  AND list_bool_or([x <> 0 for x in e])),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pair.b FROM reach JOIN pair ON pair.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
"""


@query(NEAR_SQL)
def op4_embedding_near_dedup(spark, sf_dir):
    """Links and components of every vector of ``embeddings``."""
    return near_copies(table(spark, sf_dir, "embeddings"))
