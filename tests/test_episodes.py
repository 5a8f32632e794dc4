"""Episodes, clusters, events and labels, against their definitions."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagecast.constants import DAY, HOUR, MINUTE
from stagecast.operators import episodes as e
from stagecast.operators.events import event_state, event_transitions
from stagecast.operators.labels import window_labels

START = datetime(2024, 1, 1)
GAP, QUIET, MERGE = timedelta(minutes=30), timedelta(hours=3), timedelta(hours=9)


def defined_episodes(rows, threshold):
    """Episodes from their definition, by looking back from every reading.

    A reading closes if calm readings lead up to it for QUIET: below the threshold, known, and
    no gap before any of them. Readings above with no closing one between them are an episode.
    """
    n = len(rows)
    gap = [i > 0 and rows[i][0] - rows[i - 1][0] > GAP for i in range(n)]
    above = [v is not None and v >= threshold for _, v in rows]
    calm = [v is not None and v < threshold and not g for (_, v), g in zip(rows, gap)]
    closing = [
        i for i in range(n)
        if any(all(calm[j : i + 1]) and rows[i][0] - rows[j][0] >= QUIET for j in range(max(0, i - 40), i))
    ]
    members = {}
    for i in filter(above.__getitem__, range(n)):
        members.setdefault(sum(c < i for c in closing), []).append(i)
    closed, found = [], []
    for ids in members.values():
        end = min((c for c in closing if c > ids[-1]), default=None)
        odd = any(gap[k] or rows[k][1] is None for k in range(ids[0] + 1, n if end is None else end))
        one = (rows[ids[0]][0], rows[ids[-1]][0], max(rows[i][1] for i in ids), odd or end is None)
        (found if end is None else closed).append(one)
    # closed episodes nearer than MERGE are one
    starts = [k for k in range(len(closed)) if k == 0 or closed[k][0] - closed[k - 1][1] >= MERGE]
    for k, stop in zip(starts, [*starts[1:], len(closed)]):
        part = closed[k:stop]
        found.append((part[0][0], part[-1][1], max(x[2] for x in part), any(x[3] for x in part)))
    return found


def random_series(rng):
    at, rows, level = START + timedelta(minutes=15 * rng.randrange(50)), [], 0.0
    for _ in range(rng.randrange(5, 260)):
        level = 0.9 * level + rng.gauss(0, 1)
        rows.append((at, None if rng.random() < 0.03 else round(level, 2)))
        at += timedelta(minutes=15 * (rng.choice((3, 4, 40)) if rng.random() < 0.04 else rng.choice((1, 1, 1, 2))))
    return rows


def test_episodes_follow_their_definition(spark):
    rng = random.Random(11)
    data = {f"g{i}": random_series(rng) for i in range(120)}
    rows = spark.createDataFrame(
        [(g, at, v) for g, series in data.items() for at, v in series],
        "gauge_id string, event_time timestamp_ntz, value double",
    )
    expected = {(g, *x) for g, series in data.items() for x in defined_episodes(series, 1.0)}
    assert len(expected) > 150
    for width in (2 * HOUR, DAY, 100 * DAY):
        got = e.flood_episodes(
            rows, F.lit(1.0), gap=30 * MINUTE, quiet_for=3 * HOUR, merge_within=9 * HOUR, width=width
        )
        assert {
            (r.gauge_id, r.started_at, r.last_above_at, r.maximum, r.uncertain_end) for r in got.collect()
        } == expected


EPISODE = "gauge_id string, started_at timestamp_ntz, last_above_at timestamp_ntz"


def test_storms_merge_across_gauges(spark):
    rows = spark.createDataFrame(
        [("b", datetime(2024, 1, 15), datetime(2024, 1, 16)), ("a", datetime(2024, 1, 10), datetime(2024, 1, 11))], EPISODE
    )
    got = e.storm_clusters(rows).collect()
    assert [(r.gauge_ids, r.episode_count) for r in got] == [(["a", "b"], 2)]
    assert (got[0].started_at, got[0].ended_at) == (datetime(2024, 1, 7), datetime(2024, 1, 19))


def test_storms_are_connected_components(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        start = START + timedelta(hours=rng.randrange(0, 24 * 900))
        rows.append((f"g{i % 7}", start, start + timedelta(hours=rng.randrange(0, 200))))
    margin = timedelta(hours=72)
    spans = [(start - margin, last + margin) for _, start, last in rows]
    # connected components of the spans that touch, by spreading the smallest number
    part = list(range(len(rows)))
    touching = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if max(spans[i][0], spans[j][0]) <= min(spans[i][1], spans[j][1])
    ]
    while any(part[i] != part[j] for i, j in touching):
        for i, j in touching:
            part[i] = part[j] = min(part[i], part[j])
    wanted = set()
    for p in set(part):
        mine = [i for i in range(len(rows)) if part[i] == p]
        gauges = tuple(sorted({rows[i][0] for i in mine}))
        wanted.add((min(spans[i][0] for i in mine), max(spans[i][1] for i in mine), gauges, len(mine)))
    df = spark.createDataFrame(rows, EPISODE)
    for width in (5 * DAY, 90 * DAY):
        got = e.storm_clusters(df, width=width).collect()
        assert {(r.started_at, r.ended_at, tuple(r.gauge_ids), r.episode_count) for r in got} == wanted
        bounds = e.cluster_bounds(e.storm_cluster_members(df, width=width)).collect()
        assert {(r.started_at, r.ended_at, r.gauge_count, r.episode_count) for r in bounds} == {
            (start, end, len(gauges), n) for start, end, gauges, n in wanted
        }


def test_clusters_over_a_boundary_belong_to_no_split(spark):
    rows = spark.createDataFrame(
        [(datetime(2017, 12, 25), datetime(2018, 1, 3)), (datetime(2018, 1, 5), datetime(2018, 1, 9)), (datetime(2017, 12, 20), datetime(2017, 12, 31, 23))],
        "started_at timestamp_ntz, ended_at timestamp_ntz",
    )
    got = {r.split: r.clusters for r in e.clusters_by_split(rows, date(2026, 1, 1)).collect()}
    assert got == {None: 1, "validation": 1, "training": 1}


def test_gates(spark):
    counts = spark.createDataFrame(
        [("training", 30), ("validation", 10), ("calibration", 10), (None, 4)], "split string, clusters bigint"
    ).withColumn("threshold_name", F.lit("minor"))
    assert e.pooled_gate(counts).first().pooled_gate_passed is True
    assert e.pooled_gate(counts.where("clusters <> 30")).first().pooled_gate_passed is False
    own = spark.createDataFrame(
        [("a", "training", 3), ("a", "calibration", 3), ("b", "training", 3), ("b", "calibration", 2)],
        "gauge_id string, split string, episodes bigint",
    ).withColumn("threshold_name", F.lit("minor"))
    gated = e.target_gate(own, e.pooled_gate(counts))
    assert {r.gauge_id: r.eligible for r in gated.collect()} == {"a": True, "b": False}
    assert e.overall_gate(gated).first().eligible is False


READING = "gauge_id string, seq bigint, at timestamp_ntz, batch_id string, stage double, threshold double, stale boolean"


def defined_events(rows):
    """Transitions and the last state, from the batches below since the last crossing.

    An event is open at a reading if there was a crossing and fewer than three batches have
    been below since.
    """
    live = [r for r in rows if not r[-1]]

    def open_at(k):
        crossings = [i for i in range(k + 1) if live[i][4] >= live[i][5]]
        return bool(crossings) and len({live[i][3] for i in range(crossings[-1] + 1, k + 1)}) < 3

    states = [open_at(k) for k in range(len(live))]
    out = [(r[1], "unknown_stale") for r in rows if r[-1]]
    for k, (was, now) in enumerate(zip([False, *states], states)):
        if was != now:
            out.append((live[k][1], "observed_flooding" if now else "resolved"))
    return out, bool(states) and states[-1]


def test_three_distinct_batches_close(spark):
    rows = [
        ("g", i, START, batch, stage, 12.0, False)
        for i, (batch, stage) in enumerate([("a", 12.1), ("same", 11.0), ("same", 11.0), ("b", 11.0), ("c", 11.0)])
    ]
    df = spark.createDataFrame(rows, READING)
    got = sorted((r.seq, r.transition) for r in event_transitions(df).collect())
    assert got == [(0, "observed_flooding"), (4, "resolved")]
    assert event_state(spark.createDataFrame(rows[:4], READING)).first().open is True


def test_events_follow_their_definition(spark):
    rng = random.Random(8)
    rows, expected, states = [], set(), {}
    for g in range(60):
        mine = [
            (f"g{g}", i, START + timedelta(minutes=i), f"b{i // rng.choice((1, 2, 3))}", rng.choice((11.0, 11.0, 11.0, 13.0)), 12.0, rng.random() < 0.1)
            for i in range(rng.randrange(1, 120))
        ]
        rows += mine
        out, is_open = defined_events(mine)
        expected |= {(f"g{g}", *x) for x in out}
        if not all(r[-1] for r in mine):
            states[f"g{g}"] = is_open
    df = spark.createDataFrame(rows, READING)
    for width in (7, 1000):
        got = event_transitions(df, width).collect()
        assert {(r.gauge_id, r.seq, r.transition) for r in got} == expected and len(got) == len(expected)
    assert {r.gauge_id: r.open for r in event_state(df, 7).collect()} == states


def test_window_labels_are_three_valued(spark):
    def label(values):
        rows = spark.createDataFrame(
            [("g", START + timedelta(minutes=15 * (i + 1)), v) for i, v in enumerate(values)],
            "gauge_id string, event_time timestamp_ntz, value double",
        )
        issue = spark.createDataFrame([("g", START, 12.0)], "gauge_id string, issued_at timestamp_ntz, threshold double")
        return window_labels(rows, issue, (1,)).first().crossed

    assert label([None, 12.1]) is True
    assert label([11.9]) is None
    assert label([11.9] * 4) is False
    assert label([11.9, 11.9, 11.9, 11.9, 99.0]) is False


@pytest.mark.parametrize("width", [80 * HOUR, 30 * DAY])
def test_window_labels_at_any_width(spark, width):
    rng = random.Random(6)
    at = sorted(rng.sample(range(-300 * 60, 300 * 60), 700))
    readings = [("g", START + timedelta(minutes=m), rng.choice([None, 1.0, float(rng.randrange(50))])) for m in at]
    asked = [("g", START + timedelta(minutes=m), 40.0) for m in [*rng.sample(at, 40), *rng.sample(range(-18000, 18000), 40), 0, 0]]
    found = window_labels(
        spark.createDataFrame(readings, "gauge_id string, event_time timestamp, value double"),
        spark.createDataFrame(asked, "gauge_id string, issued_at timestamp, threshold double"),
        (1, 6, 72), width=width,
    )
    assert "RANGE BETWEEN 1 FOLLOWING" not in found._jdf.queryExecution().toString().upper()
    got = sorted((r.issued_at, r.horizon_hours, r.valid_samples, -1.0 if r.maximum is None else r.maximum) for r in found.collect())
    want = []
    for _, t, _ in asked:
        for h in (1, 6, 72):
            ahead = [v for _, s, v in readings if v is not None and t < s <= t + timedelta(hours=h)]
            want.append((t.replace(tzinfo=None), h, len(ahead), max(ahead, default=-1.0)))
    assert got == sorted(want)
