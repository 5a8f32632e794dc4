"""Mixing sources to target weights (native).

A document gets the key -ln(u) / w with u from a hash of its id and w its quality weight
(Efraimidis-Spirakis), so that the k smallest keys of a source are a weighted sample
without replacement. A source's target is met by complete epochs first; the rest comes from
the documents in key order until the budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.llm.common import query, row_key, table, whole_text
from stagecast.session import materialise

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Cells of the two levels over which the running sums of a source are spread.
CELLS = 256

WORD = r"[^\x20\x09-\x0D]+"


def sampling_key(ident: Column, weight: Column, salt: str = "mix") -> Column:
    """The exponential key of a document: 52 bits of an MD5 sum made uniform in (0, 1)."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(ident.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, get the weights in turn. Targets share the sum
    of all sizes; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight. With sources ordered by cap / weight, a source is capped exactly
    if the caps before it and its own ratio times the weight that is left stay within the
    sum, so one running sum settles all rounds. The windows here see one row per source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn(
        "place", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    )
    turn = F.pmod("place", F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(int(most)))
    earlier = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("w").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(earlier), F.lit(0)))
        .withColumn(
            "capped",
            F.col("cap") * (F.col("weights") - F.col("w_before"))
            <= (F.col("total") - F.col("caps_before")) * F.col("w"),
        )
    )
    capped = F.col("capped")
    left = F.col("total") - F.sum(F.when(capped, F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.col("weights") - F.sum(F.when(capped, F.col("w")).otherwise(0)).over(everything)
    share = left.cast("double") * F.col("w") / open_weight
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, most=MOST_EPOCHS) -> DataFrame:
    """How often each document enters the mix.

    ``rows`` holds rid, rhash (see ``row_key``), source, size and weight. Returns them with
    source_size, target, epochs (whole copies) and extra (words taken of one more copy: all
    of it, none, or its first words for the document at which the budget ends). Sources of
    no words have target 0. Equal rows share a key and may swap their results. Null and
    non-positive weights count as 1. Empty input gives an empty result.

    Running sums are kept per cell, not per source: the keys of a source fall into
    CELLS x CELLS cells, whose sums are added up on two levels; rows are ordered only inside
    their cell. A source with a third of all rows is spread over all its cells.
    """
    safe = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    key = sampling_key(F.col("rid"), safe)
    # exp(-key) lies in (0, 1) and falls as the key grows
    place = F.floor((1 - F.exp(-F.col("key"))) * CELLS * CELLS).cast("int")
    rows = (
        rows.select("rid", "rhash", "source", "size", key.alias("key"))
        .withColumn("cell", F.least(place, F.lit(CELLS * CELLS - 1)))
        .withColumn("block", F.floor(F.col("cell") / CELLS).cast("int"))
    )
    rows = materialise(rows, "mix-rows")
    cells = materialise(rows.groupBy("source", "block", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    blocks = cells.groupBy("source", "block").agg(F.sum("cell_size").alias("block_size"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most)

    def before(size: str, keys: list[str], order: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(window), F.lit(0))

    blocks = blocks.withColumn("block_start", before("block_size", ["source"], "block"))
    blocks = blocks.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    blocks = blocks.select("b.source", "b.block", "b.block_start", "t.source_size", "t.target")
    starts = cells.withColumn("start", before("cell_size", ["source", "block"], "cell"))
    starts = starts.alias("c").join(
        blocks.alias("b"),
        F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.block") == F.col("b.block")),
    )
    starts = starts.select(
        "c.source", "c.cell", (F.col("c.start") + F.col("b.block_start")).alias("start"), "b.source_size", "b.target"
    )
    placed = rows.alias("r").join(
        starts.alias("s"),
        F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.cell") == F.col("s.cell")),
    )
    order = Window.partitionBy("r.source", "r.cell").orderBy("r.key", "r.rid", "r.rhash")
    inner = F.sum("r.size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("r.size")
    epochs = F.when(
        F.col("s.source_size") > 0, F.floor(F.col("s.target") / F.col("s.source_size"))
    ).otherwise(F.lit(0))
    budget = F.round(F.col("s.target")).cast("long") - epochs * F.col("s.source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("r.size"), budget - (F.col("s.start") + inner)))
    return placed.select(
        "r.rid", "r.rhash", "r.source", "r.size", "s.source_size", "s.target",
        epochs.cast("long").alias("epochs"), extra.cast("long").alias("extra"),
    )


def sized(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The input of ``mix`` from documents: words as size; weight from (doc_id, weight) if given."""
    rows = docs.select(
        *row_key(), "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size")
    )
    if quality is None:
        return rows.withColumn("weight", F.lit(1.0))
    one = quality.groupBy(F.col("doc_id").alias("qid")).agg(F.avg("weight").alias("weight"))
    return rows.join(one, rows["rid"] == one["qid"], "left").drop("qid")


def quality_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 for good ones, 0.5 for poor ones."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


MIX_SQL = r"""
WITH q AS (SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END) AS weight FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(q.weight, 1.0) AS key
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
    coalesce(sum(cap) OVER e, 0) AS caps_before, coalesce(sum(w) OVER e, 0) AS w_before
  FROM w WINDOW e AS (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (weights - w_before) <= (total - caps_before) * w AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE * w
      / (weights - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::DOUBLE END AS target FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM p
"""


@query(MIX_SQL)
def op5_mix_sources(spark, sf_dir):
    """Words the mix takes of every document of ``documents``."""
    rows = sized(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mix(rows).select(
        F.col("rid").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )
