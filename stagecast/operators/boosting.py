"""Histogram boosting over all targets and horizons in one plan.

Features are binned once. A level of all trees that grow at the same time is one aggregation of
gradient sums by (target, horizon, node, feature, bin): tasks add up their rows, the sums combine
in the shuffle, and each node takes its best cut. Gradients and errors are whole multiples of
2**-20, so sums do not depend on their order. Levels, trees and progress are small tables; rows
find their nodes by a join with a target's cuts, which Spark broadcasts while they are small.
A target whose error no longer falls stops on its own, horizon by horizon.

A fitted ensemble is a table of cuts (target, horizon, tree, node) and is scored by a fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.constants import HORIZONS
from stagecast.operators.quantiles import exact_quantiles
from stagecast.session import materialise, scratch

UNIT = 1 << 20
#: Targets whose sums a task holds before it hands them on.
HELD = 4


def relative(history: str = "history") -> Column:
    """A history relative to its last value."""
    last = F.element_at(history, -1).cast("double")
    return F.transform(history, lambda v: v.cast("double") - last)


def bin_edges(examples: DataFrame, bins: int) -> DataFrame:
    """(target_id, edges): for each feature the distinct inner quantiles of its training values."""
    values = examples.where(F.col("split") == "training").select("target_id", F.posexplode(relative()).alias("feature", "v"))
    inner = [i / bins for i in range(1, bins)]
    found = exact_quantiles(values, ["target_id", "feature"], "v", inner)
    by_feature = found.groupBy("target_id", "feature").agg(F.sort_array(F.collect_set("quantile")).alias("edges"))
    listed = F.array_sort(F.collect_list(F.struct("feature", "edges")))
    return by_feature.groupBy("target_id").agg(F.transform(listed, lambda f: f["edges"]).alias("edges"))


def _fixed(column: Column) -> Column:
    return F.rint(column * UNIT).cast("long")


def _binned(examples: DataFrame, edges: DataFrame, horizons: Sequence[int], key: str) -> DataFrame:
    """(target_id, key, split, bins, change): a value's bin is the number of edges below it."""
    last = F.element_at("history", -1).cast("double")
    below = lambda v, i: F.size(F.filter(F.get("edges", i), lambda e: e < v)).cast("tinyint")
    return examples.where(F.col("split").isin("training", "validation")).join(edges, "target_id").select(
        "target_id",
        F.col(key).alias("key"),
        "split",
        F.transform(relative(), below).alias("bins"),
        F.array(*[F.col(f"y_{h}").cast("double") - last for h in horizons]).alias("change"),
    )


def _histograms(first: int, n_horizons: int, n_bins: int):
    """Sums of gradients and rows by (target, horizon, node, feature), an array over the bins each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for name, sums in held.items():
                whole = sums[1].sum(axis=3)
                horizon, node, feature = np.nonzero(whole)
                picked = sums[:, horizon, node, feature]
                ends = pa.array(np.arange(len(horizon) + 1, dtype=np.int32) * n_bins)
                yield pa.record_batch(
                    {
                        "target_id": pa.array([name] * len(horizon), pa.string()),
                        "horizon": pa.array(horizon.astype(np.int32)),
                        "node": pa.array((node + first).astype(np.int32)),
                        "feature": pa.array(feature.astype(np.int32)),
                        "g": pa.ListArray.from_arrays(ends, pa.array(picked[0].ravel())),
                        "n": pa.ListArray.from_arrays(ends, pa.array(picked[1].ravel())),
                    }
                )
            held.clear()

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            coded = batch.column("target_id").dictionary_encode()
            owner = coded.indices.to_numpy()
            matrix = lambda c: batch.column(c).flatten().to_numpy().reshape(n, -1)
            bins, nodes, gradients = matrix("bins").astype(np.int64), matrix("nodes"), matrix("gradients")
            width = bins.shape[1]
            place = np.arange(width) * n_bins + bins
            for c, name in enumerate(coded.dictionary.to_pylist()):
                if name not in held:
                    if len(held) >= HELD:
                        yield from done()
                    held[name] = np.zeros((2, n_horizons, first, width, n_bins), dtype=np.int64)
                for h in range(n_horizons):
                    live = np.nonzero((owner == c) & (nodes[:, h] > 0))[0]
                    at = ((nodes[live, h] - first) * (width * n_bins))[:, None] + place[live]
                    np.add.at(held[name][0, h].reshape(-1), at.ravel(), np.repeat(gradients[live, h], width))
                    np.add.at(held[name][1, h].reshape(-1), at.ravel(), 1)
        yield from done()

    return run


def _best_bins(step: float, ridge: float, least: int):
    """The best cut of each (target, horizon, node, feature), of equal ones that at the lowest bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            g, n = (batch.column(c).flatten().to_numpy().reshape(rows, -1) for c in ("g", "n"))
            g = g.cumsum(axis=1) / UNIT
            n = n.cumsum(axis=1)
            left, right, left_n, right_n = g[:, :-1], g[:, -1:] - g[:, :-1], n[:, :-1], n[:, -1:] - n[:, :-1]
            gain = left**2 / (left_n + ridge) + right**2 / (right_n + ridge) - g[:, -1:] ** 2 / (n[:, -1:] + ridge)
            gain = np.where((left_n >= least) & (right_n >= least), np.round(gain, 9), -1.0)
            best = gain.argmax(axis=1)
            pick = lambda x: x[np.arange(rows), best]
            keep = np.nonzero(pick(gain) > 0)[0]
            out = {c: batch.column(c).take(pa.array(keep)) for c in ("target_id", "horizon", "node", "feature")}
            out["bin"] = pa.array(best[keep].astype(np.int32))
            out["gain"] = pa.array(pick(gain)[keep])
            out["left"] = pa.array(step * (pick(left) / (pick(left_n) + ridge))[keep])
            out["right"] = pa.array(step * (pick(right) / (pick(right_n) + ridge))[keep])
            yield pa.record_batch(out)

    return run


def _draw(share: float, *parts) -> Column:
    """Whether a hash of the parts falls into a share of its range."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) < int(share * (1 << 20))


def _descend(rows: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """Rows one level further down; a row whose node has no cut leaves the tree with its value."""
    first = 1 << level

    def one(a, h):
        cut = F.get("cuts", h * first + a["node"] - first)
        goes = F.get("bins", cut["feature"]) <= cut["bin"]
        child = F.struct(
            (a["node"] * 2 + F.when(goes, 0).otherwise(1)).alias("node"),
            F.when(goes, cut["left"]).otherwise(cut["right"]).alias("value"),
        )
        out = F.struct(F.lit(0).alias("node"), a["value"].alias("value"))
        return F.when((a["node"] > 0) & cut["feature"].isNotNull(), child).otherwise(out)

    return rows.join(cuts, "target_id", "left").withColumn("at", F.transform("at", one)).drop("cuts")


def _errors(state: DataFrame, n_horizons: int) -> DataFrame:
    gap = lambda i: F.get("change", F.lit(i)) - F.get("fit", F.lit(i))
    sums = [F.sum(_fixed(gap(i) * gap(i))) for i in range(n_horizons)]
    return state.where(F.col("split") == "validation").groupBy("target_id").agg(F.array(*sums).alias("errors"))


def grow(
    examples: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    trees: int = 1000,
    depth: int = 6,
    step: float = 0.04,
    bins: int = 32,
    patience: int = 20,
    least: int = 5,
    ridge: float = 1.0,
    rows_share: float = 0.8,
    features_share: float = 0.8,
    seed: int = 20260917,
    key: str = "issued_idx",
) -> DataFrame:
    """Boosted trees on the change from the latest value, for every target and horizon.

    ``examples`` carry ``target_id, split, history, y_<h>`` and a ``key`` that tells a target's
    rows apart. Returns the cuts ``(target_id, horizon, tree, node, feature, threshold, left,
    right)``: a row at a node goes to node 2n with the value ``left`` if its feature is at most
    the threshold, else to 2n + 1 with ``right``. Tree 0 is the mean change of the training rows.
    Trees are kept up to the one with the least validation error; a target and horizon stop
    after ``patience`` trees without a lesser one. The targets must have histories of one length.
    A tree takes ``depth`` passes over the binned rows, whatever the number of targets.
    """
    spark, n = examples.sparkSession, len(horizons)
    edges = materialise(bin_edges(examples, bins), "edges")
    rows = _binned(examples, edges, horizons, key)
    training = materialise(rows, "binned")
    mean = [
        F.sum(_fixed(F.get("change", F.lit(i)))) / (F.count("*") * UNIT) for i in range(n)
    ]
    base = materialise(
        training.where(F.col("split") == "training").groupBy("target_id").agg(F.array(*mean).alias("fit")), "base"
    )
    state = materialise(training.join(base, "target_id"), "boosting")
    start = F.transform("errors", lambda e: F.struct(e.alias("error"), F.lit(0).alias("tree")))
    progress = materialise(_errors(state, n).select("target_id", start.alias("best")), "progress")
    forest = scratch(spark, "forest")
    for tree in range(1, trees + 1):
        grows = F.transform(
            "best",
            lambda b: F.struct(F.when(b["tree"] + patience >= tree, 1).otherwise(0).alias("node"), F.lit(0.0).alias("value")),
        )
        at = state.join(progress.select("target_id", grows.alias("at")), "target_id")
        for level in range(depth):
            cuts = _level(at, level, tree, n, bins, step, ridge, least, rows_share, features_share, seed, forest)
            at = _descend(at, cuts, level)
        fit = F.zip_with("fit", "at", lambda f, a: f + a["value"]).alias("fit")
        state = materialise(at.select("target_id", "key", "split", "bins", "change", fit), "boosting")
        better = F.zip_with(
            "best", "errors",
            lambda b, e: F.when(e < b["error"], F.struct(e.alias("error"), F.lit(tree).alias("tree"))).otherwise(b),
        )
        progress = progress.join(_errors(state, n), "target_id").select("target_id", better.alias("best"))
        progress = materialise(progress, "progress")
        if progress.where(F.exists("best", lambda b: b["tree"] + patience > tree)).isEmpty():
            break
    return _ensemble(forest, base, progress, edges, horizons)


def _level(at, level, tree, n, bins, step, ridge, least, rows_share, features_share, seed, forest) -> DataFrame:
    """(target_id, cuts) of one level of the trees that grow, written below ``forest`` row by row."""
    first = 1 << level
    sampled = at.where((F.col("split") == "training") & _draw(rows_share, "target_id", "key", F.lit(tree), F.lit(seed)))
    gradients = F.zip_with("change", "fit", lambda c, f: _fixed(c - f)).alias("gradients")
    nodes = F.transform("at", lambda a: a["node"].cast("int")).alias("nodes")
    sampled = sampled.where(F.exists("at", lambda a: a["node"] > 0)).select("target_id", "bins", nodes, gradients)
    fields = "target_id string, horizon int, node int, feature int"
    sums = sampled.mapInArrow(_histograms(first, n, bins), f"{fields}, g array<long>, n array<long>")
    sums = sums.where(_draw(features_share, "target_id", "feature", F.lit(tree), F.lit(seed)))
    each = lambda c: F.array(*[F.sum(F.get(c, F.lit(b))) for b in range(bins)]).alias(c)
    sums = sums.groupBy("target_id", "horizon", "node", "feature").agg(each("g"), each("n"))
    found = sums.mapInArrow(_best_bins(step, ridge, least), f"{fields}, bin int, gain double, left double, right double")
    cut = F.struct("feature", "bin", "left", "right")
    best = found.groupBy("target_id", "horizon", "node").agg(
        F.max_by(cut, F.struct(F.col("gain"), (-F.col("feature")).alias("f"))).alias("cut")
    )
    path = f"{forest}/tree={tree}/level={level}"
    best.select("target_id", "horizon", "node", "cut.*").write.parquet(path)
    stored = at.sparkSession.read.schema(f"{fields}, bin int, left double, right double").parquet(path)
    placed = F.map_from_entries(F.collect_list(F.struct(F.col("horizon") * first + F.col("node") - first, cut)))
    whole = F.transform(F.sequence(F.lit(0), F.lit(n * first - 1)), lambda i: F.col("placed")[i])
    return stored.groupBy("target_id").agg(placed.alias("placed")).select("target_id", whole.alias("cuts"))


def _ensemble(forest: str, base: DataFrame, progress: DataFrame, edges: DataFrame, horizons: Sequence[int]) -> DataFrame:
    spark = base.sparkSession
    numbers = F.array(*[F.lit(h) for h in horizons])
    kind = "target_id string, horizon int, node int, feature int, bin int, left double, right double, tree int, level int"
    last = progress.select("target_id", F.posexplode("best").alias("horizon", "b")).select("target_id", "horizon", F.col("b.tree").alias("most"))
    cuts = spark.read.schema(kind).parquet(forest).join(last, ["target_id", "horizon"]).where("tree <= most").join(edges, "target_id")
    edge = F.get(F.get("edges", F.col("feature")), F.col("bin"))
    name = F.get(numbers, F.col("horizon")).alias("horizon")
    trees = cuts.select("target_id", name, "tree", "node", "feature", edge.alias("threshold"), "left", "right")
    means = base.select("target_id", F.posexplode("fit").alias("horizon", "left")).select(
        "target_id", name, F.lit(0).alias("tree"), F.lit(1).alias("node"), F.lit(0).alias("feature"),
        F.lit(float("inf")).alias("threshold"), "left", F.col("left").alias("right"),
    )
    return materialise(means.unionByName(trees), "ensemble")


def folded(ensemble: DataFrame) -> DataFrame:
    """(target_id, forest): for each horizon the target's trees in order, each an array of its cuts by node."""
    cut = F.struct("feature", "threshold", "left", "right")
    by_tree = ensemble.groupBy("target_id", "horizon", "tree").agg(
        F.map_from_entries(F.collect_list(F.struct("node", cut))).alias("by_node"), F.max("node").alias("top")
    )
    nodes = F.transform(F.sequence(F.lit(1), F.col("top")), lambda i: F.col("by_node")[i])
    by_horizon = by_tree.groupBy("target_id", "horizon").agg(
        F.array_sort(F.collect_list(F.struct("tree", nodes.alias("nodes")))).alias("trees")
    )
    return by_horizon.groupBy("target_id").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", F.transform("trees", lambda t: t["nodes"])))).alias("forest")
    )


def score(rows: DataFrame, ensemble: DataFrame, horizons: Sequence[int] = HORIZONS, how: str = "inner") -> DataFrame:
    """Rows ``(target_id, history, ..)`` with ``p_<h>``, the latest value plus the sum over the trees.

    A fold over the arrays of a target's cuts; with ``how = "left"`` targets without an ensemble stay, unscored.
    """
    deep = 12  # no tree is deeper: 2**12 nodes a level

    def through(tree):
        start = F.struct(F.lit(1).alias("node"), F.lit(0.0).alias("value"))

        def one(a, _):
            cut = F.get(tree, a["node"] - 1)
            goes = F.get("relative", cut["feature"]) <= cut["threshold"]
            child = F.struct(
                (a["node"] * 2 + F.when(goes, 0).otherwise(1)).alias("node"),
                F.when(goes, cut["left"]).otherwise(cut["right"]).alias("value"),
            )
            return F.when((a["node"] > 0) & cut["feature"].isNotNull(), child).otherwise(
                F.struct(F.lit(0).alias("node"), a["value"].alias("value"))
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(deep)), start, one)["value"]

    joined = rows.join(folded(ensemble), "target_id", how).withColumn("relative", relative())
    last = F.element_at("history", -1).cast("double")
    sums = {
        f"p_{h}": last + F.aggregate(F.col("forest")[h], F.lit(0.0), lambda acc, t: acc + through(t)) for h in horizons
    }
    return joined.withColumns(sums).drop("forest", "relative")
