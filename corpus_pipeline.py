"""A training corpus from raw documents: five stages, each a table the next one reads.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. Rows are told apart by id and text, so ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecast.llm import bpe, mixing, quality, secrets, simhash
from stagecast.llm.common import keyed_join, row_key, small_batches, table
from stagecast.session import materialise


def _whole(docs: DataFrame) -> DataFrame:
    """Documents as (row, rid, rhash), the row a struct, so that no column can clash."""
    return docs.select(F.struct("*").alias("row"), *row_key())


def _columns(rows: DataFrame, row: str = "row") -> DataFrame:
    return rows.select(f"{row}.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at THRESHOLD or more.

    It learns from ``labels`` on ``docs``; without labelled documents it keeps everything.
    """
    net = quality.classifier(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.score(docs, net).filter(F.col("score") >= quality.THRESHOLD))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Of several rows with that id, the one with the smallest fingerprint and text hash stays;
    a group in which every id is null keeps one row in the same way.
    """
    found = materialise(simhash.near_copies(docs), "near-copies")
    heads = found.filter(F.col("rid").eqNullSafe(F.col("component_id")))
    first = Window.partitionBy("component").orderBy("fp", "rhash")
    heads = heads.withColumn("place", F.row_number().over(first)).filter("place = 1").select("rid", "rhash")
    kept = keyed_join(_whole(docs), materialise(heads, "kept"))
    # repeated rows share a key: one of them is enough
    one = kept.withColumn("copy", F.row_number().over(Window.partitionBy("rid", "rhash").orderBy("rhash")))
    return _columns(one.filter("copy = 1"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret's span overwritten by ``[SECRET]``; n_chars follows the text.

    Overlapping spans are masked as one. Documents without secrets stay as they are.
    """
    found = secrets.scan(docs).filter(F.size("spans") > 0).select("rid", "rhash", "spans")
    found = found.dropDuplicates(["rid", "rhash"])
    rows = keyed_join(_whole(docs), found, "left")
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    small_batches(spark)
    new = rows.select("row", F.col("row.text").alias("text"), "spans").mapInArrow(_mask, f"row {kind}, new string")
    changed = F.col("new").isNotNull()
    fields = {
        "text": F.when(changed, F.col("new")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("new").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return new.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the masked text where there are spans, else null."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        new = [None] * len(batch)
        for i, found in enumerate(spans):
            if found:
                new[i] = secrets.masked(batch.column("text")[i].as_py(), [(s["start"], s["stop"]) for s in found])
        yield batch.select(["row"]).append_column("new", pa.array(new, pa.string()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: the extra part counts from half its words on."""
    rows = mixing.sized(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))
    taken = mixing.mix(rows)
    copies = F.col("epochs") + F.when((F.col("size") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    taken = taken.select("rid", "rhash", copies.alias("copies")).groupBy("rid", "rhash").agg(F.max("copies").alias("copies"))
    kept = keyed_join(_whole(docs), taken.filter("copies > 0"))
    return _columns(kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the text's token ids, and whether decoding them gives the text back."""
    path = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(docs, path), path)
    same = F.col("decoded") == F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return rows.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding", encoded),
]

#: The classifier and the fingerprints have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
