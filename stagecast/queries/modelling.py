"""Examples, models, metrics, gates and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecast.constants import DAY, HEADLINE_HORIZONS, HORIZONS, HOUR, PERSISTENCE_OFFSETS, QUANTILES
from stagecast.functions.columns import (
    decross,
    micros,
    step_index,
)
from stagecast.operators import features as x
from stagecast.operators import forecast as f
from stagecast.operators import models as m
from stagecast.operators import views
from stagecast.plans import challengers
from stagecast.plans.training import train_ridge, train_trees, with_split
from stagecast.queries.bindings import (
    CANON,
    DAILY_CUTOFF,
    DAILY_SPLITS,
    DAILY_SQL,
    FIT_SQL,
    HOURLY_CUTOFF,
    HOURLY_SPLITS,
    HOURLY_SQL,
    OBS,
    POOLED_DAILY_SQL,
    POOLED_OBS,
    daily,
    day_of,
    examples_sql,
    hourly,
    query,
    rounded,
    samples,
    split_sql,
    table,
)
from stagecast.plans.features import build_feature_set
from stagecast.session import materialise, scratch
from stagecast.sources.tables import challenger_records, manifest, merge_forecasts

LABELS = x.label_names()
FEATURES = list(x.TARGET_FEATURES)


def daily_examples(spark: SparkSession, d: str) -> DataFrame:
    found = x.horizon_examples(daily(spark, d), width=512)
    return with_split(found, day_of(F.col("idx")), DAILY_CUTOFF, DAILY_SPLITS)


def stored_examples(spark: SparkSession, d: str) -> DataFrame:
    """The feature set as models read it: from a table, since each fit and score reads it again."""
    return materialise(daily_examples(spark, d), "examples")


def _split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


_EX = f"{DAILY_SQL}, {examples_sql('daily', DAY)}"
_FIT = f"{_EX}, {FIT_SQL}"
_WIDE_LABELS = ", ".join(f"round(y_{h}, 6) AS y_{h}" for h in HORIZONS)


@query(f"""WITH {_EX} SELECT target_id, idx, round(x1, 6) AS target_stage_ft,
  round(x2, 6) AS target_change_1h_ft, {_WIDE_LABELS}, split FROM ex""")
def horizon_examples(spark: SparkSession, d: str) -> DataFrame:
    return rounded(daily_examples(spark, d), *FEATURES, *LABELS)


_HOURLY_EX = f"{POOLED_OBS}, {CANON}, {HOURLY_SQL}, {examples_sql('hourly', HOUR)}"


@query(f"""WITH {_HOURLY_EX}
SELECT target_id, h AS horizon, count(*) AS examples, round(avg(abs(x1 - y)), 6) AS mae
FROM exl GROUP BY 1, 2""")
def persistence_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Readings to canonical revisions, hourly means, labels and the error of persistence."""
    examples = x.horizon_examples(hourly(spark, d, "ALL"))
    scored = m.persistence(examples, "target_stage_ft")
    return rounded(m.long_mae(m.horizon_mae(scored)), "mae")


#: A series' upstream gauges are the ones that follow it in order, with these lags.
_LAGS = ((1, 5), (2, 2), (3, 9))
_UP_NAMES = [f"upstream_{i}" for i in range(len(_LAGS))]


def _lags(spark: SparkSession, d: str) -> DataFrame:
    """Three upstream series of every target, ``(target_id, gauge_id, lag_hours)``."""
    names = daily(spark, d).select("series").distinct()  # a handful of names
    place = (F.row_number().over(Window.partitionBy().orderBy("series")) - 1).alias("n")
    ranked = names.select("series", place, F.count("*").over(Window.partitionBy()).alias("total"))
    steps = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(lag).alias("lag_hours")) for step, lag in _LAGS])
    asked = ranked.select(F.col("series").alias("target_id"), "n", "total", F.inline(steps)).select(
        "target_id", "lag_hours", ((F.col("n") + F.col("step")) % F.col("total")).alias("n")
    )
    return asked.join(ranked.select("n", F.col("series").alias("gauge_id")), "n").drop("n")


def upstream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Examples of all targets with the values of their upstream gauges, in the order of the gauges."""
    found = x.add_upstream(daily_examples(spark, d), daily(spark, d), _lags(spark, d))
    return x.name_upstream(found, _UP_NAMES)


_UP = f"""nm AS (SELECT series, row_number() OVER (ORDER BY series) - 1 AS n, count(*) OVER () AS total
  FROM (SELECT DISTINCT series FROM daily)),
lg AS (SELECT a.series AS up_target, b.series AS gauge_id, k.lag FROM nm a
  JOIN (VALUES {", ".join(f"({s}, {lag})" for s, lag in _LAGS)}) k(step, lag) ON true
  JOIN nm b ON b.n = (a.n + k.step) % a.total),
up AS (SELECT lg.up_target, u.idx + lg.lag AS up_idx, list(u.value ORDER BY u.series) AS v
  FROM lg JOIN daily u ON u.series = lg.gauge_id GROUP BY 1, 2 HAVING count(*) = {len(_LAGS)})"""
_UP_COLUMNS = ", ".join(f"round(v[{i + 1}], 6) AS {name}" for i, name in enumerate(_UP_NAMES))


@query(f"""WITH {_EX}, {_UP} SELECT target_id, ex.idx, round(x1, 6) AS target_stage_ft,
  round(x2, 6) AS target_change_1h_ft, {_WIDE_LABELS}, split, {_UP_COLUMNS}
FROM ex JOIN up ON up_target = target_id AND up_idx = ex.idx""")
def upstream_examples(spark: SparkSession, d: str) -> DataFrame:
    found = upstream_daily(spark, d)
    return rounded(found, *FEATURES, *LABELS, *_UP_NAMES)


@query(f"""WITH {_EX}, {_UP} SELECT target_id, ex.idx, round(x1, 6) AS target_stage_ft, split,
  list_transform(v, lambda u: round(u, 6)) AS upstream,
  (SELECT list(gauge_id || '@' || lag ORDER BY gauge_id) FROM lg WHERE lg.up_target = target_id) AS upstream_gauges
FROM ex JOIN up ON up_target = target_id AND up_idx = ex.idx
WHERE make_timestamp(ex.idx * {DAY}) < DATE '{DAILY_CUTOFF}' + INTERVAL 1 DAY""")
def feature_set(spark: SparkSession, d: str) -> DataFrame:
    """Frozen lags, the drift check, and examples written by target and read back."""
    series, report = daily(spark, d), _lags(spark, d).withColumn("suitable", F.lit(True))
    frozen = materialise(manifest(report, {"daily": series}, DAILY_CUTOFF, DAILY_SPLITS), "manifest")
    found = build_feature_set(
        frozen, {"daily": series}, series, series, day_of(F.col("idx")), DAILY_CUTOFF,
        scratch(spark, "features"), DAILY_SPLITS, width=512,
    )
    return rounded(found, "target_stage_ft").select(
        "target_id", "idx", "target_stage_ft", "split", "upstream_gauges",
        F.transform("upstream", lambda u: F.round(u, 6)).alias("upstream"),
    )


def sequences(spark: SparkSession, d: str, lookback: int = 168) -> DataFrame:
    found = x.sequence_examples(daily(spark, d, pooled=True), lookback, width=1024)
    return _daily_split(found)


def _daily_split(found: DataFrame) -> DataFrame:
    return with_split(found, day_of(F.col("issued_idx")), DAILY_CUTOFF, DAILY_SPLITS)


def sequences_sql(src: str, lookback: int) -> str:
    at = "max(v) OVER (PARTITION BY series ORDER BY idx RANGE BETWEEN {0} FOLLOWING AND {0} FOLLOWING)"
    labels = ", ".join(f"{at.format(h + 1)} AS y_{h}" for h in HORIZONS)
    whole = " AND ".join(f"y_{h} IS NOT NULL" for h in HORIZONS)
    day = f"CAST(make_timestamp((w.idx + 1) * {DAY}) AS DATE)"
    return f"""fl AS (SELECT series, idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM {src}),
w AS (SELECT series, idx, v, count(*) OVER k AS steps, sum(v) OVER k AS total, sum(v * v) OVER k AS squares,
  first_value(v) OVER k AS first_value, {labels} FROM fl
  WINDOW k AS (PARTITION BY series ORDER BY idx RANGE BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW)),
seq AS (SELECT w.series AS target_id, w.idx + 1 AS issued_idx, first_value, w.v AS last_value, total, squares,
  {", ".join(f"y_{h}" for h in HORIZONS)}, {split_sql(day, DAILY_SPLITS, DAILY_CUTOFF, True)} AS split
  FROM w WHERE steps = {lookback} AND {whole})"""


_SEQ = f"{POOLED_DAILY_SQL}, {sequences_sql('daily', 168)}"
_SEQ_COLUMNS = f"""target_id, issued_idx, round(first_value, 4) AS first_value, round(last_value, 4) AS last_value,
  round(total, 3) AS total, {", ".join(f"round(y_{h}, 4) AS y_{h}" for h in HORIZONS)}, split"""


def _sequence_columns(df: DataFrame) -> DataFrame:
    as_double = F.transform("history", lambda v: v.cast("double"))
    return df.select(
        "target_id",
        "issued_idx",
        F.round(F.element_at(as_double, 1), 4).alias("first_value"),
        F.round(F.element_at(as_double, -1), 4).alias("last_value"),
        F.round(F.aggregate(as_double, F.lit(0.0), lambda a, v: a + v), 3).alias("total"),
        *[F.round(F.col(y).cast("double"), 4).alias(y) for y in LABELS],
        "split",
    )


@query(f"WITH {_SEQ} SELECT {_SEQ_COLUMNS} FROM seq")
def sequence_examples(spark: SparkSession, d: str) -> DataFrame:
    return _sequence_columns(sequences(spark, d))


_THIN = f"""{_SEQ}, thin AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY target_id, split ORDER BY issued_idx) - 1 AS k FROM seq) WHERE k % 12 = 0)"""


def _thinned(spark: SparkSession, d: str) -> DataFrame:
    return x.thinned_examples(daily(spark, d, pooled=True), 12, _daily_split, 168, width=1024)


@query(f"WITH {_THIN} SELECT {_SEQ_COLUMNS} FROM thin")
def thinned_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _sequence_columns(_thinned(spark, d))


@query(f"""WITH {_THIN} SELECT target_id, count(*) AS training_examples,
  round(sqrt(sum(squares - 2 * last_value * total + 168 * last_value * last_value) / (168 * count(*))
    - (sum(total - 168 * last_value) / (168 * count(*))) ** 2), 4) AS input_scale,
  {", ".join(f"round(stddev_pop(y_{h} - last_value), 4) AS target_scale_{h}" for h in HORIZONS)}
FROM thin WHERE split = 'training' GROUP BY 1""")
def sequence_scales(spark: SparkSession, d: str) -> DataFrame:
    found = x.sequence_scales(_split(_thinned(spark, d), "training"))
    return rounded(found, "input_scale", *[f"target_scale_{h}" for h in HORIZONS], digits=4)


@query(f"""WITH {_THIN}, sc AS (SELECT target_id,
  {", ".join(f"stddev_pop(y_{h} - last_value) AS s_{h}" for h in HORIZONS)}
  FROM thin WHERE split = 'training' GROUP BY 1)
SELECT target_id, issued_idx, {", ".join(f"round((y_{h} - last_value) / s_{h}, 3) AS y_{h}" for h in HORIZONS)}
FROM seq JOIN sc USING (target_id) WHERE split = 'validation'""")
def normalised_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Validation labels relative to the last value, by the training scales."""
    scales = x.sequence_scales(_split(_thinned(spark, d), "training"))
    found = x.normalise_sequences(_split(sequences(spark, d), "validation"), scales)
    return found.select(
        "target_id",
        "issued_idx",
        *[F.round(F.col("y")[i].cast("double"), 3).alias(f"y_{h}") for i, h in enumerate(HORIZONS)],
    )


def _relative_sql(value: str, scale: str) -> str:
    """A value relative to the last one, in the operator's single precision; no negative zero."""
    gap = f"CAST(CAST({value} AS FLOAT) - CAST(last_value AS FLOAT) AS DOUBLE)"
    return f"round(CAST(CAST({gap} / {scale} AS FLOAT) AS DOUBLE), 3) + 0.0"


@query(f"""WITH {_THIN}, steps AS (SELECT target_id, issued_idx, last_value, f.idx, f.v FROM
  (SELECT *, unnest(range(issued_idx - 168, issued_idx)) AS at FROM seq) s JOIN fl f ON f.series = target_id AND f.idx = s.at),
xs AS (SELECT target_id, stddev_pop(v - s.last_value) AS s_x FROM steps s
  JOIN thin USING (target_id, issued_idx) WHERE split = 'training' GROUP BY 1),
ys AS (SELECT target_id, {", ".join(f"stddev_pop(y_{h} - last_value) AS s_{h}" for h in HORIZONS)}
  FROM thin WHERE split = 'training' GROUP BY 1),
sc AS (SELECT target_id, CASE WHEN s_x = 0 THEN 1 ELSE s_x END AS s_x,
  {", ".join(f"CASE WHEN s_{h} = 0 THEN 1 ELSE s_{h} END AS s_{h}" for h in HORIZONS)} FROM xs JOIN ys USING (target_id)),
hs AS (SELECT target_id, issued_idx, list({_relative_sql("v", "s_x")} ORDER BY idx) AS x
  FROM steps JOIN sc USING (target_id) GROUP BY 1, 2)
SELECT target_id, issued_idx, split, round(last_value, 4) AS current, x,
  [{", ".join(_relative_sql(f"y_{h}", f"s_{h}") for h in HORIZONS)}] AS y
FROM seq JOIN sc USING (target_id) JOIN hs USING (target_id, issued_idx)""")
def normalised_examples(spark: SparkSession, d: str) -> DataFrame:
    """Histories x and labels y of all splits relative to the last value, by the training scales."""
    scales = x.sequence_scales(_split(_thinned(spark, d), "training"))
    found = x.normalise_sequences(sequences(spark, d), scales, keep=["split"])
    shown = lambda c: F.transform(c, lambda v: F.round(v.cast("double"), 3) + F.lit(0.0)).alias(c)
    current = F.round(F.col("current").cast("double"), 4).alias("current")
    return found.select("target_id", "issued_idx", "split", current, shown("x"), shown("y"))


@query(f"""WITH {POOLED_OBS}, {CANON}, {HOURLY_SQL},
issues AS (SELECT DISTINCT series, idx + 1 AS issued_idx FROM hourly),
steps AS (SELECT series, issued_idx, unnest(range(issued_idx - 168, issued_idx)) AS idx FROM issues),
found AS (SELECT s.series, s.issued_idx, s.idx, h.value FROM steps s
  LEFT JOIN hourly h ON h.series = s.series AND h.idx = s.idx)
SELECT series, issued_idx, issued_idx - 1 AS input_ends_idx,
  CASE WHEN count(value) = 168 THEN array_to_string(list(round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) ORDER BY idx), ',') END AS history,
  min(idx) FILTER (value IS NULL) AS first_missing_idx
FROM found GROUP BY 1, 2""")
def live_histories(spark: SparkSession, d: str) -> DataFrame:
    series = hourly(spark, d, "ALL")
    issues = series.select("series", (F.col("idx") + 1).alias("issued_idx"))
    found = x.live_histories(series, issues, 168)
    shown = F.transform("history", lambda v: F.round(v.cast("double"), 3).cast("string"))
    return found.withColumn("history", F.when(F.col("history").isNotNull(), F.array_join(shown, ",")))



@query(f"""WITH {_FIT} SELECT target_id, h AS horizon, n AS training_examples, round(m1, 6) AS mean_1,
  round(m2, 6) AS mean_2, round(s1, 6) AS scale_1, round(s2, 6) AS scale_2, round(my, 6) AS intercept,
  round(w1, 6) AS weight_1, round(w2, 6) AS weight_2 FROM fit""")
def ridge_target_only(spark: SparkSession, d: str) -> DataFrame:
    model = m.fit_ridge(_split(daily_examples(spark, d), "training"), FEATURES)
    return model.select(
        "target_id",
        "training_examples",
        F.round(F.col("feature_means")[0], 6).alias("mean_1"),
        F.round(F.col("feature_means")[1], 6).alias("mean_2"),
        F.round(F.col("feature_scales")[0], 6).alias("scale_1"),
        F.round(F.col("feature_scales")[1], 6).alias("scale_2"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(h).alias("horizon"),
                        F.round(F.col("intercept")[i], 6).alias("intercept"),
                        F.round(F.col("weights")[0][i], 6).alias("weight_1"),
                        F.round(F.col("weights")[1][i], 6).alias("weight_2"),
                    )
                    for i, h in enumerate(HORIZONS)
                ]
            )
        ),
    )


@query()
def ridge_with_upstream(spark: SparkSession, d: str) -> DataFrame:
    """Both variants of every target, the choice by the gate, and the calibrated model."""
    examples = materialise(upstream_daily(spark, d), "examples")
    return train_ridge(examples, _UP_NAMES)["models"]


@query()
def ridge_report(spark: SparkSession, d: str) -> DataFrame:
    examples = materialise(upstream_daily(spark, d), "examples")
    return train_ridge(examples, _UP_NAMES)["report"]


def _scored(examples: DataFrame, split: str) -> DataFrame:
    model = m.fit_ridge(_split(examples, "training"), FEATURES)
    return m.predict(_split(examples, split), model, FEATURES)


@query(f"""WITH {_EX} SELECT target_id, h AS horizon, count(*) AS examples, round(avg(abs(x1 - y)), 6) AS mae
FROM exl WHERE split = 'validation' GROUP BY 1, 2""")
def persistence_mae(spark: SparkSession, d: str) -> DataFrame:
    scored = m.persistence(_split(daily_examples(spark, d), "validation"), "target_stage_ft")
    return rounded(m.long_mae(m.horizon_mae(scored)), "mae")


@query(f"""WITH {_FIT} SELECT target_id, h AS horizon, count(*) AS examples, round(avg(abs(p - y)), 6) AS mae
FROM scored WHERE split = 'validation' GROUP BY 1, 2""")
def ridge_mae(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.long_mae(m.horizon_mae(_scored(stored_examples(spark, d), "validation"))), "mae")


_LEVELS = """levels AS (SELECT target_id, h, quantile_cont(y, 0.95) AS level FROM exl
  WHERE split = 'training' GROUP BY 1, 2)"""


def _high(prediction: str) -> str:
    return f"""coalesce(avg(abs({prediction} - y)) FILTER (y >= level), CAST('Infinity' AS DOUBLE))"""


@query(f"""WITH {_FIT}, {_LEVELS} SELECT target_id, round({_high('p')}, 6) AS high_stage_mae
FROM scored JOIN levels USING (target_id, h) WHERE split = 'validation' GROUP BY 1""")
def high_stage_mae(spark: SparkSession, d: str) -> DataFrame:
    examples = stored_examples(spark, d)
    levels = m.label_thresholds(_split(examples, "training"))
    return rounded(m.high_stage_mae(_scored(examples, "validation"), levels), "high_stage_mae")


_Q_LIST = ", ".join(f"{{'probability': CAST({q} AS DOUBLE), 'residual': quantile_cont(y - p, {q})}}" for q in QUANTILES)


@query(f"""WITH {_FIT}, q AS (SELECT target_id, h AS horizon, unnest([{_Q_LIST}], recursive := true)
  FROM scored WHERE split = 'calibration' GROUP BY target_id, h)
SELECT target_id, horizon, probability, round(residual, 6) AS residual FROM q""")
def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.residual_quantiles(_scored(stored_examples(spark, d), "calibration")), "residual")


_METRICS = f"""{_FIT}, {_LEVELS},
mae AS (SELECT target_id, h, avg(abs(p - y)) AS ridge, avg(abs(x1 - y)) AS pers
  FROM scored WHERE split = 'validation' GROUP BY 1, 2),
high AS (SELECT target_id, {_high('p')} AS ridge, {_high('x1')} AS pers
  FROM scored JOIN levels USING (target_id, h) WHERE split = 'validation' GROUP BY 1),
changes AS (SELECT target_id, max((ridge - pers) / greatest(0.01, pers)) AS worst,
  avg((pers - ridge) / greatest(0.01, pers)) AS gain FROM mae WHERE h IN (1, 6, 24) GROUP BY 1)"""


def _metric_rows(scored: DataFrame, levels: DataFrame) -> DataFrame:
    return m.horizon_mae(scored).join(m.high_stage_mae(scored, levels), "target_id")


@query(f"""WITH {_METRICS} SELECT target_id, 'ridge' AS model, worst <= 0.05 AND gain >= 0.02
  AND (h.ridge - h.pers) / greatest(0.01, h.pers) <= 0.05 AS promotion_allowed
FROM changes JOIN high h USING (target_id)""")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Ridge as a challenger of persistence."""
    examples = stored_examples(spark, d)
    levels = m.label_thresholds(_split(examples, "training"))
    base = _metric_rows(m.persistence(_split(examples, "validation"), "target_stage_ft"), levels)
    ridge = _metric_rows(_scored(examples, "validation"), levels).withColumn("model", F.lit("ridge"))
    return m.compare(base, ridge).select("target_id", "model", "promotion_allowed")


@query(f"""WITH {_FIT}, mae AS (SELECT target_id, h, avg(abs(p - y)) AS e FROM scored
  WHERE split = 'validation' GROUP BY 1, 2)
SELECT target_id, round(avg(e), 6) AS headline_mae FROM mae WHERE h IN (1, 6, 24) GROUP BY 1""")
def headline_score(spark: SparkSession, d: str) -> DataFrame:
    found = m.headline_score(m.horizon_mae(_scored(stored_examples(spark, d), "validation")), HEADLINE_HORIZONS)
    return rounded(found.select("target_id", "headline_mae"), "headline_mae")


@query(f"""WITH {_FIT}, s AS (SELECT split, target_id, avg(abs(p - y)) AS score, h AS seed FROM scored
  WHERE split IS NOT NULL GROUP BY 1, 2, 4)
SELECT split, target_id, seed AS selected_seed, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY split, target_id ORDER BY score, seed) = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Lowest score per target and split; the horizon plays the part of a seed."""
    examples = stored_examples(spark, d)
    model = m.fit_ridge(_split(examples, "training"), FEATURES)
    mae = m.horizon_mae(m.predict(examples, model, FEATURES), keys=("target_id", "split"))
    scores = m.long_mae(mae).where(F.col("split").isNotNull()).select(
        "split", "target_id", F.col("mae").alias("score"), F.col("horizon").alias("seed")
    )
    return rounded(m.best_seed(scores, ("split", "target_id")), "score")


_PINBALL_Q = ", ".join(f"CAST({q} AS DOUBLE)" for q in QUANTILES)


def _interval_rows(examples: DataFrame) -> DataFrame:
    """Validation quantiles of the ridge: its centre plus the calibrated residual."""
    offsets = m.residual_quantiles(_scored(examples, "calibration"))
    scored = _scored(examples, "validation")
    long = scored.select(
        "target_id",
        "idx",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(h).alias("horizon"), F.col(f"p_{h}").alias("p"), F.col(f"y_{h}").alias("actual"))
                    for h in HORIZONS
                ]
            )
        ),
    )
    return long.join(offsets, ["target_id", "horizon"]).select(
        "target_id", "idx", "horizon", F.col("probability").alias("quantile"),
        F.col("p").alias("center"), (F.col("p") + F.col("residual")).alias("prediction"), "actual",
    )


@query(f"""WITH {_FIT}, q AS (SELECT target_id, h, unnest([{_Q_LIST}], recursive := true)
  FROM scored WHERE split = 'calibration' GROUP BY target_id, h),
e AS (SELECT target_id, probability AS k, y - (p + residual) AS err FROM scored JOIN q USING (target_id, h)
  WHERE split = 'validation')
SELECT target_id, round(avg(greatest(k * err, (k - 1) * err)), 6) AS pinball_loss FROM e GROUP BY 1""")
def pinball_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.pinball(_interval_rows(stored_examples(spark, d))), "pinball_loss")


@query(f"""WITH {_FIT}, q AS (SELECT target_id, h, unnest([{_Q_LIST}], recursive := true)
  FROM scored WHERE split = 'calibration' GROUP BY target_id, h)
SELECT target_id, h AS horizon, idx, round(min(p - residual), 6) AS lowest, round(max(p - residual), 6) AS highest,
  true AS ordered FROM scored JOIN q USING (target_id, h) WHERE split = 'validation' GROUP BY 1, 2, 3""")
def decrossed_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Mirrored residuals arrive in falling order and are sorted per row and horizon."""
    mirrored = _interval_rows(stored_examples(spark, d)).withColumn(
        "value", 2 * F.col("center") - F.col("prediction")
    )
    rows = mirrored.groupBy("target_id", "horizon", "idx").agg(F.collect_list("value").alias("v"))
    return rows.withColumn("v", decross(F.col("v"))).select(
        "target_id", "horizon", "idx",
        F.round(F.element_at("v", 1), 6).alias("lowest"),
        F.round(F.element_at("v", -1), 6).alias("highest"),
        F.forall(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i - 1) <= F.get("v", i)).alias("ordered"),
    )


@query("""WITH e AS (SELECT l_returnflag || l_linestatus AS target_id,
  l_extendedprice * (1 - l_discount) - l_extendedprice AS err FROM lineitem)
SELECT target_id, round(avg(abs(err)), 4) AS mae_cfs, round(sqrt(avg(err * err)), 4) AS rmse_cfs,
  round(avg(err), 4) AS signed_bias_cfs FROM e GROUP BY 1""")
def paired_errors(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("target_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("prediction"),
        F.col("l_extendedprice").alias("actual"),
    )
    return rounded(m.paired_errors(pairs), "mae_cfs", "rmse_cfs", "signed_bias_cfs", digits=4)


#: Settings of the boosted trees here: few, shallow trees in large steps, to keep the query short.
TREES = {"trees": 5, "depth": 3, "step": 0.3, "bins": 16, "patience": 3}


@query()
def tree_challenger(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on daily histories, grown until the validation error stops falling."""
    rows = materialise(sequences(spark, d), "sequences")
    return train_trees(rows, **TREES)["report"]


@query()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees of the pooled daily series against its target-only ridge, with the gate's answer."""
    rows = materialise(sequences(spark, d), "sequences")
    found = with_split(x.horizon_examples(daily(spark, d, pooled=True), width=512), day_of(F.col("idx")), DAILY_CUTOFF, DAILY_SPLITS)
    ridge = train_ridge(materialise(found, "examples"))["report"]
    _, first, last = next(s for s in DAILY_SPLITS if s[0] == "validation")
    return challengers.comparison(ridge, train_trees(rows, **TREES)["report"], (first.isoformat(), last.isoformat()))


LIVE_LOOKBACK = 168


@query()
def live_challengers(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees of the pooled hourly series on the live history of every hour of every gauge.

    A row per horizon and quantile of each record, or one with a reason for what has none: gaps,
    and gauges that no ensemble was fitted for. Records and failures are stored twice over by
    a cycle that runs again, which adds nothing.
    """
    pooled = hourly(spark, d, "ALL")
    series = materialise(pooled.unionByName(hourly(spark, d)), "hourly")
    own = series.where(F.col("series") == "ALL")
    rows = with_split(x.sequence_examples(own, LIVE_LOOKBACK), day_of(F.col("issued_idx"), HOUR), HOURLY_CUTOFF, HOURLY_SPLITS)
    rows = materialise(rows, "sequences")
    whole = rows.groupBy("target_id").agg(F.count_distinct("split").alias("n")).where(F.col("n") >= 3)
    rows = rows.join(whole.select("target_id"), "target_id", "left_semi")
    fitted = train_trees(rows, **TREES)
    issues = series.select(F.col("series").alias("target_id"), (F.col("idx") + 1).alias("issued_idx"))
    found = challengers.cycle(
        series, issues, fitted["ensemble"], fitted["residuals"],
        challengers.lookbacks(fitted["ensemble"], LIVE_LOOKBACK), LIVE_LOOKBACK,
    )
    folder = scratch(spark, "challengers")
    for _ in range(2):
        challengers.append_cycle(found, folder)
    records = spark.read.parquet(f"{folder}/records").drop("issued_on")
    failures = spark.read.parquet(f"{folder}/failures").drop("issued_on")
    return records.unionByName(failures, allowMissingColumns=True)


# --- forecasts ---------------------------------------------------------------

FLOOD = 60.0


def forecast_issues(readings: DataFrame) -> DataFrame:
    """Issue times two hours and five minutes into every hour with a reading, so that ages run
    from fresh to suppressed."""
    hour = F.date_trunc("hour", "event_time").cast("timestamp_ntz")
    return readings.select(
        "gauge_id", (hour + F.expr("interval 125 minutes")).alias("issued_at")
    ).distinct()


def _state(spark: SparkSession, d: str) -> DataFrame:
    stored = materialise(samples(spark, d).select("gauge_id", "event_time", "value", "payload_hash"), "samples")
    return f.issue_state(stored, forecast_issues(stored), width=3 * DAY)


def _thresholds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("target_id"), F.lit(FLOOD).alias("flood_stage_ft")
    ).distinct()


_STATE = f"""{OBS}, {CANON}, nn AS (SELECT * FROM canon WHERE value IS NOT NULL),
issues AS (SELECT DISTINCT gauge_id, date_trunc('hour', event_time) + INTERVAL 125 MINUTE AS issued_at FROM canon),
latest AS (SELECT i.gauge_id, i.issued_at, o.event_time, o.value, o.payload_hash FROM issues i
  ASOF LEFT JOIN nn o ON o.gauge_id = i.gauge_id AND o.event_time <= i.issued_at),
prior AS (SELECT l.gauge_id, l.issued_at, p.value AS prior_value FROM latest l JOIN nn p
  ON p.gauge_id = l.gauge_id AND p.event_time BETWEEN l.event_time - INTERVAL 75 MINUTE
    AND l.event_time - INTERVAL 45 MINUTE
  QUALIFY row_number() OVER (PARTITION BY l.gauge_id, l.issued_at ORDER BY
    abs(epoch_us(l.event_time) - epoch_us(p.event_time) - 3600000000), p.event_time) = 1),
recent AS (SELECT i.gauge_id, i.issued_at, count(*) AS recent_count, arg_min(r.value, r.event_time) AS recent_first
  FROM issues i JOIN nn r ON r.gauge_id = i.gauge_id AND r.event_time BETWEEN i.issued_at - INTERVAL 6 HOUR
    AND i.issued_at GROUP BY 1, 2),
state AS (SELECT l.gauge_id AS target_id, l.issued_at, l.event_time, l.value, l.payload_hash, prior_value,
  coalesce(recent_count, 0) AS recent_count, recent_first,
  (epoch_us(l.issued_at) - epoch_us(l.event_time)) / 60000000 AS age,
  CASE WHEN (epoch_us(l.issued_at) - epoch_us(l.event_time)) <= 5400000000 THEN 'supported'
    WHEN (epoch_us(l.issued_at) - epoch_us(l.event_time)) <= 7200000000 THEN 'degraded'
    WHEN l.event_time IS NOT NULL THEN 'suppressed' END AS freshness
  FROM latest l LEFT JOIN prior USING (gauge_id, issued_at) LEFT JOIN recent USING (gauge_id, issued_at))"""


@query(f"""WITH {_STATE} SELECT target_id, issued_at, event_time AS newest_observation_at, value AS observed_value,
  prior_value, recent_first, recent_count, round(age, 6) AS observation_age_minutes, freshness FROM state""")
def issue_state(spark: SparkSession, d: str) -> DataFrame:
    found = _state(spark, d).drop("observed_hash")
    ntz = {n: F.col(n).cast("timestamp_ntz") for n in ("issued_at", "newest_observation_at")}
    return rounded(found.withColumns(ntz), "observation_age_minutes")


@query(f"""WITH {_STATE} SELECT target_id, issued_at, CASE
  WHEN event_time IS NULL THEN 'no reading'
  WHEN freshness = 'suppressed' THEN 'too old'
  ELSE 'no earlier reading' END AS reason
FROM state WHERE event_time IS NULL OR freshness = 'suppressed' OR prior_value IS NULL""")
def forecast_refusals(spark: SparkSession, d: str) -> DataFrame:
    found = f.refusals(_state(spark, d), needs_prior=True)
    return found.select("target_id", F.col("issued_at").cast("timestamp_ntz").alias("issued_at"), "reason")


_Q_ROWS = ", ".join(f"({q}, {z})" for q, z in PERSISTENCE_OFFSETS.items())
_H_ROWS = ", ".join(f"({h})" for h in HORIZONS)
_IDS = """substring(sha256(target_id || '|' || strftime(issued_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' ||
    payload_hash || '|direct'), 1, 24)"""
_PERSISTENCE = f"""{_STATE}, hz AS (SELECT * FROM (VALUES {_H_ROWS}) t(h)),
qz AS (SELECT CAST(q AS DOUBLE) AS q, CAST(z AS DOUBLE) AS z FROM (VALUES {_Q_ROWS}) t(q, z)),
base AS (SELECT *, substring(sha256({_IDS} || '|persistence-damped-v1'), 1, 24) AS id,
  CASE WHEN recent_count < 2 THEN 0 ELSE (value - recent_first) / greatest(1, recent_count - 1) END AS slope
  FROM state WHERE freshness IN ('supported', 'degraded')),
pts AS (SELECT base.*, h, value + slope * 6 * (1 - exp(-h / 6.0)) AS c, 0.08 + 0.06 * sqrt(h) AS spread FROM base, hz),
tops AS (SELECT *, greatest(value, max(c) OVER (PARTITION BY target_id, issued_at ORDER BY h)) AS mx,
  greatest(0, 500 * pow(greatest(c, 0), 1.5)) AS flow FROM pts),
qs AS (SELECT id, target_id, issued_at, freshness, h, q, greatest(0, c + z * spread) AS stage,
  greatest(0, mx + z * spread * 1.15) AS maximum, greatest(0, flow + z * greatest(25, flow * 0.15)) AS discharge
  FROM tops, qz)"""


def _persistence(spark: SparkSession, d: str) -> DataFrame:
    return f.persistence_forecasts(_state(spark, d), _thresholds(spark, d))


def _quantile_table(forecasts: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """A row per forecast, horizon and quantile with a column per part."""
    zipped = F.arrays_zip(*[F.col(p) for p in parts])
    rows = forecasts.select("id", "target_id", "issued_at", F.explode(zipped).alias("z"))
    q = F.explode(F.map_keys(F.col(f"z.{parts[0]}.quantiles")))
    rows = rows.withColumn("q", q)
    return rows.select(
        "id",
        "target_id",
        F.col("issued_at").cast("timestamp_ntz").alias("issued_at"),
        F.col(f"z.{parts[0]}.horizon_hours").alias("horizon_hours"),
        F.col("q").cast("double").alias("quantile"),
        *[F.round(F.col(f"z.{p}.quantiles")[F.col("q")], 4).alias(p) for p in parts],
    )


@query(f"""WITH {_PERSISTENCE} SELECT id, target_id, issued_at, h AS horizon_hours, q AS quantile,
  round(stage, 4) AS stage, round(maximum, 4) AS maximum_stage, round(discharge, 4) AS discharge FROM qs""")
def forecast_persistence(spark: SparkSession, d: str) -> DataFrame:
    return _quantile_table(_persistence(spark, d), ("stage", "maximum_stage", "discharge"))


@query(f"""WITH {_PERSISTENCE} SELECT id, target_id, issued_at, 'minor' AS threshold_name, h AS horizon_hours,
  max(maximum) FILTER (q = 0.5) >= {FLOOD} AS median_crosses,
  max(maximum) FILTER (q = 0.05) < {FLOOD} AND {FLOOD} <= max(maximum) FILTER (q = 0.95)
    AS forecast_interval_straddles
FROM qs GROUP BY 1, 2, 3, h""")
def threshold_crossings(spark: SparkSession, d: str) -> DataFrame:
    rows = f.crossing_rows(_persistence(spark, d)).drop("threshold_ft")
    return rows.withColumn("issued_at", F.col("issued_at").cast("timestamp_ntz"))


@query(f"""WITH {_PERSISTENCE} SELECT id, target_id, issued_at, freshness,
  CASE WHEN freshness = 'degraded' THEN 'observation age exceeds 90 minutes' ELSE '' END AS reasons
FROM base QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY issued_at DESC) = 1""")
def latest_forecast(spark: SparkSession, d: str) -> DataFrame:
    return views.latest_forecast(_persistence(spark, d)).select(
        "id", "target_id", F.col("issued_at").cast("timestamp_ntz").alias("issued_at"), "freshness",
        F.array_join("degradation_reasons", ",").alias("reasons"),
    )


@query(f"""WITH {_PERSISTENCE}, newest AS (SELECT id FROM base ORDER BY issued_at DESC, id LIMIT 1)
SELECT id, target_id, issued_at, freshness FROM base WHERE id IN (SELECT id FROM newest)""")
def forecast_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The newest forecast of all, read by its id."""
    issued = materialise(_persistence(spark, d), "issued")
    newest = issued.orderBy(F.col("issued_at").desc(), "id").select("id").first()
    found = views.forecast_by_id(issued, newest.id if newest else "")
    return found.select("id", "target_id", F.col("issued_at").cast("timestamp_ntz").alias("issued_at"), "freshness")


@query(f"""WITH {_PERSISTENCE} SELECT target_id, count(*) AS stored, count(DISTINCT id) AS ids,
  count(*) FILTER (issued_at >= TIMESTAMP '2024-01-15') AS reissued FROM base GROUP BY 1""")
def forecast_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Reissued forecasts replace the stored ones with the same id."""
    stored = _persistence(spark, d).withColumn("model_status", F.lit("baseline"))
    again = stored.where(F.col("issued_at") >= F.lit("2024-01-15").cast("timestamp")).withColumn(
        "model_status", F.lit("reissued")
    )
    return merge_forecasts(stored, again).groupBy("target_id").agg(
        F.count("*").alias("stored"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.col("model_status") == "reissued").alias("reissued"),
    )


@query(f"""WITH {_PERSISTENCE}, marked AS (SELECT target_id, id, h, CASE CAST(extract(hour FROM issued_at) AS INT) % 4
    WHEN 1 THEN max(stage) - min(stage) WHEN 2 THEN max(maximum) - min(maximum)
    WHEN 3 THEN max(discharge) - min(discharge) ELSE 0 END AS fall FROM qs GROUP BY target_id, id, issued_at, h),
m AS (SELECT target_id, id, max(fall) > 0 AS crosses FROM marked GROUP BY 1, 2)
SELECT target_id, count(*) FILTER (NOT crosses) AS ordered, count(*) FILTER (crosses) AS crossing FROM m GROUP BY 1""")
def quantile_order_check(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts kept and rejected where the hour of issue decides which part's quantiles are mirrored."""
    issued = _persistence(spark, d)
    turn = F.hour("issued_at") % 4
    for i, part in enumerate(f.PARTS, 1):
        mirrored = F.transform(part, lambda p: p.withField("quantiles", F.transform_values(p["quantiles"], lambda _, v: -v)))
        issued = issued.withColumn(part, F.when(turn == i, mirrored).otherwise(F.col(part)))
    marked = f.ordered_only(issued).select("target_id", F.lit(1).alias("good")).unionByName(
        f.crossing_quantiles(issued).select("target_id", F.lit(0).alias("good"))
    )
    return marked.groupBy("target_id").agg(
        F.count_if(F.col("good") == 1).alias("ordered"), F.count_if(F.col("good") == 0).alias("crossing")
    )


def hourly_models(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated target-only ridge models of the hourly event gauges."""
    found = x.horizon_examples(hourly(spark, d))
    examples = materialise(
        with_split(found, day_of(F.col("idx"), HOUR), HOURLY_CUTOFF, HOURLY_SPLITS), "hourly-examples"
    )
    model = m.fit_ridge(_split(examples, "training"), FEATURES)
    scored = m.predict(_split(examples, "calibration"), model, FEATURES)
    return model.join(m.residual_offsets(m.residual_quantiles(scored)), "target_id")


_RIDGE = f"""{_STATE}, {HOURLY_SQL}, {examples_sql('hourly', HOUR)}, {FIT_SQL},
q AS (SELECT target_id, h, unnest([{_Q_LIST}], recursive := true)
  FROM scored WHERE split = 'calibration' GROUP BY target_id, h),
base AS (SELECT *, substring(sha256({_IDS} || '|direct-ridge-stage-v1-' || target_id), 1, 24) AS id
  FROM state WHERE freshness IN ('supported', 'degraded') AND prior_value IS NOT NULL),
pts AS (SELECT b.id, b.target_id, b.issued_at, b.value, f.h, q.probability, greatest(0, my + (b.value - m1) / s1 * w1
  + (b.value - prior_value - m2) / s2 * w2 + residual) AS stage
  FROM base b JOIN fit f USING (target_id) JOIN q ON q.target_id = f.target_id AND q.h = f.h)"""


@query(f"""WITH {_RIDGE} SELECT id, target_id, issued_at, h AS horizon_hours, probability AS quantile,
  round(stage, 4) AS stage, round(greatest(value, max(stage) OVER (
    PARTITION BY id, probability ORDER BY h)), 4) AS maximum_stage FROM pts""")
def forecast_ridge(spark: SparkSession, d: str) -> DataFrame:
    issued = f.ridge_forecasts(_state(spark, d), hourly_models(spark, d), _thresholds(spark, d))
    return _quantile_table(issued, ("stage", "maximum_stage"))


@query()
def challenger_shadow_records(spark: SparkSession, d: str) -> DataFrame:
    """Ridge forecasts as append-only nested challenger records."""
    issued = f.ridge_forecasts(_state(spark, d), hourly_models(spark, d), _thresholds(spark, d))
    rows = f.quantile_rows(issued).select(
        "target_id", "issued_at",
        F.timestamp_micros(step_index(micros(F.col("issued_at")), HOUR) * HOUR - HOUR).alias("input_ends"),
        F.lit("ridge").alias("model"), F.col("horizon_hours").alias("horizon"), "quantile", "value",
    )
    return challenger_records(rows)
