"""How good warnings and probabilities were: events hit, lead, Brier score, reliability, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.constants import DAY, HOUR
from stagecast.functions.columns import micros
from stagecast.session import materialise

#: Errors are summed in whole multiples of this, so that sums do not depend on their order.
UNIT = 2.0**-20


def _cell(us: Column, cell: int) -> Column:
    return F.floor(us / cell).cast("bigint")


def _over_cells(df: DataFrame, first: str, last: str, cell: int) -> DataFrame:
    return df.withColumn("cell", F.explode(F.sequence(_cell(F.col(first), cell), _cell(F.col(last), cell))))


def warned_episodes(warnings: DataFrame, episodes: DataFrame, cell: int = 3 * DAY) -> DataFrame:
    """Warnings ``(target_id, issued_at, from_at, to_at)`` that share time with an episode
    ``(target_id, started_at, last_above_at)``: a row for each such pair, times in microseconds.

    Both intervals are laid over cells of time, so a target with most episodes is spread over its
    cells; a pair is given in the cell where the shared time begins, and so once. Repeated rows
    count once; intervals with a null or that end before they begin are left out.
    """
    w = warnings.select(
        "target_id", micros(F.col("issued_at")).alias("issued"), micros(F.col("from_at")).alias("w_from"),
        micros(F.col("to_at")).alias("w_to"),
    ).where("w_from <= w_to").distinct()
    e = episodes.select(
        "target_id", micros(F.col("started_at")).alias("started"), micros(F.col("last_above_at")).alias("ended")
    ).where("started <= ended").distinct()
    both = _over_cells(w, "w_from", "w_to", cell).join(_over_cells(e, "started", "ended", cell), ["target_id", "cell"])
    shared = (F.col("w_from") <= F.col("ended")) & (F.col("started") <= F.col("w_to"))
    begins = _cell(F.greatest("w_from", "started"), cell)
    return both.where(shared & (F.col("cell") == begins)).drop("cell")


def event_scores(warnings: DataFrame, episodes: DataFrame, cell: int = 3 * DAY) -> DataFrame:
    """Per target: episodes warned of before they start, false alarms, and the first warning's lead.

    An episode is hit by a warning issued before it starts; one that comes later is only late. A
    warning is false if it shares no time with any episode. Ratios over nothing are null.
    """
    pairs = materialise(warned_episodes(warnings, episodes, cell), "warned")
    first = pairs.groupBy("target_id", "started", "ended").agg(F.min("issued").alias("first"))
    lead = (F.col("started") - F.col("first")) / float(HOUR)
    per_episode = first.groupBy("target_id").agg(
        F.count_if(F.col("first") < F.col("started")).alias("hits"),
        F.count_if(F.col("first") >= F.col("started")).alias("late"),
        F.avg(F.when(F.col("first") < F.col("started"), lead)).alias("mean_lead_hours"),
        F.max(F.when(F.col("first") < F.col("started"), lead)).alias("longest_lead_hours"),
    )
    useful = pairs.select("target_id", "issued", "w_from", "w_to").distinct().groupBy("target_id").agg(
        F.count("*").alias("useful")
    )
    all_episodes = episodes.where("started_at <= last_above_at").select("target_id", "started_at", "last_above_at").distinct()
    all_warnings = warnings.where("from_at <= to_at").select("target_id", "issued_at", "from_at", "to_at").distinct()
    counts = all_episodes.groupBy("target_id").agg(F.count("*").alias("episodes")).join(
        all_warnings.groupBy("target_id").agg(F.count("*").alias("warnings")), "target_id", "full_outer"
    )
    joined = counts.join(per_episode, "target_id", "left").join(useful, "target_id", "left")
    joined = joined.fillna(0, ["episodes", "warnings", "hits", "late", "useful"])
    ratio = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return joined.select(
        "target_id",
        "episodes",
        "hits",
        "late",
        (F.col("episodes") - F.col("hits") - F.col("late")).alias("missed"),
        ratio(F.col("hits"), "episodes").alias("recall"),
        "warnings",
        (F.col("warnings") - F.col("useful")).alias("false_alarms"),
        ratio(F.col("warnings") - F.col("useful"), "warnings").alias("false_alarm_ratio"),
        "mean_lead_hours",
        "longest_lead_hours",
    )


def exceedance(quantiles: Column, threshold: Column) -> Column:
    """Probability of reaching a threshold, from a map of quantile label to value.

    Linear between the quantiles around the threshold; beyond the outermost ones their own level.
    """
    entries = F.array_sort(
        F.transform(F.map_entries(quantiles), lambda e: F.struct(e["key"].cast("double").alias("q"), e["value"].alias("v")))
    )
    below = F.try_element_at(F.filter(entries, lambda e: e["v"] < threshold), F.lit(-1))
    above = F.get(F.filter(entries, lambda e: e["v"] >= threshold), F.lit(0))
    part = (threshold - below["v"]) / (above["v"] - below["v"])
    at = (
        F.when(below.isNull(), above["q"])
        .when(above.isNull(), below["q"])
        .otherwise(below["q"] + (above["q"] - below["q"]) * part)
    )
    return F.lit(1.0) - at


def brier_scores(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier score of ``(p, happened)`` next to those of climatology and of never warning.

    Rows without a probability or a known outcome are left out. ``skill`` is the share of the
    climatology's score that is saved, null where everything or nothing happened.
    """
    p, y = F.col("p"), F.col("happened").cast("int")
    known = scored.where(p.isNotNull() & F.col("happened").isNotNull())
    rows = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg((p - y) * (p - y)).alias("brier")
    )
    climatology = F.col("base_rate") * (1 - F.col("base_rate"))
    return rows.select(
        *by, "n", "base_rate", "brier",
        climatology.alias("brier_climatology"),
        F.col("base_rate").alias("brier_never"),
        F.when(climatology > 0, 1 - F.col("brier") / climatology).alias("skill"),
    )


def reliability(scored: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Per bin of probability: how many, the mean probability and the share that happened."""
    known = scored.where(F.col("p").isNotNull() & F.col("happened").isNotNull())
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return known.groupBy(*by, place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("happened").cast("int")).alias("observed_share")
    )


def storm_blocks(points: DataFrame, clusters: DataFrame, block: int = 14 * DAY, cell: int = 30 * DAY) -> DataFrame:
    """Points with the unit they are drawn in: their storm cluster, else a calendar block.

    ``points`` have ``issued_at``; ``clusters`` are disjoint ``(started_at, ended_at)``. They meet
    by cells of time, so the work follows the cells a cluster covers and not the points' number.
    """
    spans = clusters.select(micros(F.col("started_at")).alias("storm"), micros(F.col("ended_at")).alias("storm_ends"))
    spans = _over_cells(spans.where("storm <= storm_ends"), "storm", "storm_ends", cell)
    placed = points.withColumn("us", micros(F.col("issued_at"))).withColumn("cell", _cell(F.col("us"), cell))
    within = (placed["cell"] == spans["cell"]) & placed["us"].between(spans["storm"], spans["storm_ends"])
    unit = F.coalesce(
        F.concat(F.lit("storm "), F.col("storm").cast("string")),
        F.concat(F.lit("calendar "), _cell(F.col("us"), block).cast("string")),
    )
    return placed.join(spans, within, "left").select(*[placed[c] for c in points.columns], unit.alias("block"))


def poisson_weight(uniform: Column) -> Column:
    """The Poisson(1) count whose distribution function first reaches a uniform number."""
    total, weight = 0.0, F.lit(0)
    for k in range(14):
        total += exp(-1.0) / factorial(k)
        weight = weight + (uniform > total).cast("int")
    return weight


def paired_bootstrap(
    errors: DataFrame,
    by: Sequence[str] = ("horizon_hours",),
    replicates: int = 1000,
    seed: str = "0",
    confidence: float = 0.95,
    floor: float = 0.01,
    share: float = 0.01,
) -> DataFrame:
    """Whether a candidate's absolute errors are no worse than the champion's, by blocks of storms.

    ``errors`` are ``(*by, block, candidate, champion)``. Blocks are summed first; each replicate
    then counts a block a Poisson(1) number of times, drawn from a hash of seed, block and
    replicate: all horizons share the draws, and reruns agree. ``upper`` is the one-sided bound on
    candidate minus champion; non-inferior is one of at most ``floor`` or ``share`` of the
    champion's error. One aggregation over blocks x replicates, combined before the shuffle.
    """
    known = errors.where(F.col("candidate").isNotNull() & F.col("champion").isNotNull())
    units = lambda c: F.round(c / UNIT).cast("bigint")
    sums = known.groupBy(*by, "block").agg(
        F.sum(units(F.col("candidate") - F.col("champion"))).alias("d"),
        F.sum(units(F.col("champion"))).alias("c"),
        F.count("*").alias("n"),
    )
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    text = F.concat_ws("|", F.lit(seed), "block", F.col("replicate").cast("string"))
    uniform = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)
    # replicate 0 is the data as they are
    weight = F.when(F.col("replicate") == 0, F.lit(1)).otherwise(poisson_weight(uniform))
    each = (
        drawn.withColumn("w", weight)
        .groupBy(*by, "replicate")
        .agg(
            F.sum(F.col("w") * F.col("d")).alias("d"), F.sum(F.col("w") * F.col("c")).alias("c"),
            F.sum(F.col("w") * F.col("n")).alias("n"), F.count("*").alias("blocks"),
        )
    )
    delta = F.when(F.col("n") > 0, F.col("d") * F.lit(UNIT) / F.col("n"))
    plain = F.col("replicate") == 0
    drawn_delta = F.when(~plain, F.col("delta"))
    return (
        each.withColumn("delta", delta)
        .withColumn("drawn", drawn_delta)
        .groupBy(*by)
        .agg(
            F.max(F.when(plain, F.col("blocks"))).alias("blocks"),
            F.max(F.when(plain, F.col("n"))).alias("pairs"),
            F.max(F.when(plain, F.col("c") * F.lit(UNIT) / F.col("n"))).alias("champion_mae"),
            F.max(F.when(plain, F.col("delta"))).alias("difference"),
            F.expr(f"percentile_disc({confidence}) WITHIN GROUP (ORDER BY drawn)").alias("upper"),
        )
        .withColumn("allowed", F.greatest(F.lit(floor), F.col("champion_mae") * share))
        .withColumn("non_inferior", F.col("upper") <= F.col("allowed"))
    )
