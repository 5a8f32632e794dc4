"""Own forecasts against official runs: by creation time, and as they stood at each issue.

A run is a series of points that belong together; nothing is interpolated across runs, before a
run's first point or after its last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.constants import DAY, HORIZONS, HOUR, MINUTE
from stagecast.functions.columns import from_micros, micros
from stagecast.operators.blocks import before_block, in_block, with_blocks

RUN = ("target_id", "run_id", "created_at")


def bracketed(points: DataFrame, asks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of ``asks`` with ``found`` and ``how``: a run's value at the asked ``valid_at``.

    ``points`` are ``(*keys, valid_at, value)``, ``keys`` name a run. A point at the very time is
    ``exact``; between two points of the run the value is ``interpolated``; otherwise both are
    null. Points without a finite value do not count; of several at one time the greatest does.
    Points and asks of a run meet in one shuffle, a run being bounded by its reach.
    """
    at, value = F.col("us"), F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    held = points.select(*keys, micros(F.col("valid_at")).alias("us"), value.cast("double").alias("value")).where(finite)
    asked = asks.select(*keys, micros(F.col("valid_at")).alias("us"), F.struct(*asks.columns).alias("ask"))
    rows = held.unionByName(asked, allowMissingColumns=True).withColumn("back", -at)
    run = Window.partitionBy(*keys)

    def nearest(order: str) -> Column:
        upto = run.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        return F.max(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), "value"))).over(upto)

    # the window over ``back`` runs the other way, so that no frame is open towards the end
    sided = rows.withColumns({"before": nearest("us"), "after": nearest("back")}).where(F.col("ask").isNotNull())
    first, last = F.col("before.at"), -F.col("after.at")
    between = F.col("before.value") + (F.col("after.value") - F.col("before.value")) * ((at - first) / (last - first))
    exact = first == at
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    return sided.select(
        "ask.*",
        F.when(exact, F.col("before.value")).when(both, between).alias("found"),
        F.when(exact, "exact").when(both, "interpolated").alias("how"),
    )


def _observed(rows: DataFrame, truth: DataFrame) -> DataFrame:
    seen = truth.select("target_id", "valid_at", F.col("value").alias("observed"))
    return rows.join(seen, ["target_id", "valid_at"], "left")


def creation_aligned(own: DataFrame, official: DataFrame, truth: DataFrame, reach: int = 72 * HOUR) -> DataFrame:
    """Official points against the own run issued at exactly their creation time.

    ``own`` is ``(target_id, issued_at, valid_at, value)``, ``official`` ``(target_id, run_id,
    created_at, valid_at, value)``, ``truth`` ``(target_id, valid_at, value)``, one row a time. Own
    points are interpolated at the official valid times up to ``reach`` after creation. A run
    without a creation time takes no part.
    """
    ahead = micros(F.col("valid_at")) - micros(F.col("created_at"))
    asks = official.where((ahead >= 0) & (ahead <= reach)).select(
        *RUN, "valid_at", F.col("value").alias("official"), F.col("created_at").alias("issued_at")
    )
    found = bracketed(own, asks, ("target_id", "issued_at")).withColumnRenamed("found", "own").drop("issued_at")
    return _observed(found, truth)


def newest_runs(official: DataFrame, issues: DataFrame, lag: int = 120 * MINUTE, width: int = 10 * DAY) -> DataFrame:
    """At each ``(target_id, issued_at)`` the official run created last among those available.

    A run is available at its ``available_at`` or, where that is null or no such column, ``lag``
    after its creation. ``run`` holds the creation time, id and bounds, null where there is none.
    Runs and issues share blocks of time; the newest run of earlier blocks is carried over.
    """
    known = F.col("available_at") if "available_at" in official.columns else F.lit(None).cast("timestamp")
    valid = micros(F.col("valid_at"))
    runs = (
        official.where(F.col("created_at").isNotNull() & F.col("value").isNotNull())
        .groupBy(*RUN)
        .agg(F.max(micros(known)).alias("given"), F.min(valid).alias("first"), F.max(valid).alias("last"))
        .withColumn("created", micros(F.col("created_at")))
    )
    run = F.struct("created", "run_id", "created_at", "first", "last").alias("run")
    held = runs.select("target_id", F.coalesce("given", F.col("created") + lag).alias("us"), run)
    asked = issues.select("target_id", micros(F.col("issued_at")).alias("us"), "issued_at").distinct()
    rows = with_blocks(held.unionByName(asked, allowMissingColumns=True), "us", width).drop("home")
    upto = in_block(["target_id"], "us").rangeBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("newest", F.max("run").over(upto))
    carried = before_block(
        rows.groupBy("target_id", "block").agg(F.max("run").alias("carried")), ["target_id"], maxima=["carried"]
    )
    return (
        local.where(F.col("issued_at").isNotNull())
        .join(carried, ["target_id", "block"], "left")
        .select("target_id", "issued_at", F.greatest("newest", "carried").alias("run"))
    )


def operational(
    own: DataFrame,
    official: DataFrame,
    truth: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    lag: int = 120 * MINUTE,
    width: int = 10 * DAY,
) -> DataFrame:
    """What a user could compare at each own issue: per horizon the newest available official run.

    Inputs as in ``creation_aligned``; ``own`` holds a point per horizon. ``how`` says whether the
    run has a point at the valid time or two around it; ``age_hours`` is its age at the issue.
    """
    found = newest_runs(official, own.select("target_id", "issued_at"), lag, width)
    hours = F.explode(F.array(*[F.lit(h) for h in horizons]))
    asks = found.withColumn("horizon_hours", hours).withColumn("us", micros(F.col("issued_at")) + F.col("horizon_hours") * F.lit(HOUR))
    # asks beyond the run's points never join it: an old run would gather those of all later issues
    inside = F.coalesce(F.col("us").between(F.col("run.first"), F.col("run.last")), F.lit(False))
    asks = asks.select(
        "target_id",
        F.col("run.run_id").alias("run_id"),
        F.col("run.created_at").alias("created_at"),
        F.when(inside, F.lit(0)).otherwise(F.col("us")).cast("bigint").alias("apart"),
        "issued_at",
        "horizon_hours",
        from_micros(F.col("us")).cast(own.schema["valid_at"].dataType).alias("valid_at"),
        ((micros(F.col("issued_at")) - F.col("run.created")) / F.lit(float(HOUR))).alias("age_hours"),
    )
    points = official.select(*RUN, F.lit(0).cast("bigint").alias("apart"), "valid_at", "value")
    rows = bracketed(points, asks, (*RUN, "apart")).withColumnRenamed("found", "official").drop("apart")
    mine = own.select("target_id", "issued_at", "valid_at", F.col("value").alias("own"))
    return _observed(rows.join(mine, ["target_id", "issued_at", "valid_at"], "left"), truth)


def skill(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute errors of both forecasts over the rows that have both and a truth.

    ``asked`` and ``matched`` give the coverage; without a match the errors are null, not zero.
    """
    whole = F.col("own").isNotNull() & F.col("official").isNotNull() & F.col("observed").isNotNull()
    error = lambda name: F.avg(F.when(whole, F.abs(F.col(name) - F.col("observed"))))
    return rows.groupBy(*by).agg(
        F.count("*").alias("asked"),
        F.count_if(whole).alias("matched"),
        F.count_if(whole & (F.col("how") == "interpolated")).alias("interpolated"),
        error("own").alias("own_mae"),
        error("official").alias("official_mae"),
    )
