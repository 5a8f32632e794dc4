"""Comparisons, event scores and the bootstrap against plain restatements."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagecast.constants import DAY, HOUR
from stagecast.operators import comparison as c
from stagecast.operators import verification as v

START = datetime(2026, 1, 1)


def hours(n):
    return START + timedelta(hours=n)


POINT = "target_id string, run_id string, created_at timestamp, valid_at timestamp, value double"


def official(spark, *rows):
    made = [(t, r, None if made is None else hours(made), hours(at), value) for t, r, made, at, value in rows]
    return spark.createDataFrame(made, POINT)


def own(spark, *rows):
    made = [(t, hours(issued), hours(at), value) for t, issued, at, value in rows]
    return spark.createDataFrame(made, "target_id string, issued_at timestamp, valid_at timestamp, value double")


def truth(spark, *rows):
    made = [(t, hours(at), value) for t, at, value in rows]
    return spark.createDataFrame(made, "target_id string, valid_at timestamp, value double")


def test_creation_aligned(spark):
    mine = own(spark, ("a", 0, 1, 1.0), ("a", 0, 6, 6.0), ("a", 0, 12, 0.0), ("a", 5, 8, 100.0), ("a", 0, 9, float("nan")))
    theirs = official(
        spark, ("a", "r", 0, 0, 9.0), ("a", "r", 0, 3, 9.0), ("a", "r", 0, 6, 9.0), ("a", "r", 0, 9, 9.0),
        ("a", "r", 0, 15, 9.0), ("a", "r", 0, 80, 9.0), ("a", "s", 2, 8, 9.0), ("a", "u", None, 6, 9.0),
    )
    found = c.creation_aligned(mine, theirs, truth(spark, ("a", 3, 2.5))).collect()
    got = {(r.run_id, (r.valid_at - START).total_seconds() / 3600): (r.own, r.how, r.observed) for r in found}
    assert got == {
        ("r", 0): (None, None, None),  # before the first own point
        ("r", 3): (3.0, "interpolated", 2.5),
        ("r", 6): (6.0, "exact", None),
        ("r", 9): (3.0, "interpolated", None),  # the point without a number is none
        ("r", 15): (None, None, None),  # after the last
        ("s", 8): (None, None, None),  # no own run issued then; runs are not mixed
    }


@pytest.mark.parametrize("width", [HOUR, 7 * HOUR, 40 * DAY])
def test_newest_available_run(spark, width):
    rng = random.Random(3)
    made = sorted(rng.sample(range(200), 30))
    runs = [("a", f"r{m:03d}", m, m + rng.randint(1, 12)) for m in made]
    df = spark.createDataFrame(
        [(t, r, hours(m), hours(m + 5), 1.0, hours(av)) for t, r, m, av in runs], POINT + ", available_at timestamp"
    )
    issues = spark.createDataFrame([("a", hours(i)) for i in range(0, 220, 3)], "target_id string, issued_at timestamp")
    got = {r.issued_at: r.run and r.run.run_id for r in c.newest_runs(df, issues, width=width).collect()}
    for i in range(0, 220, 3):
        known = [(m, r) for _, r, m, av in runs if av <= i]
        assert got[hours(i)] == (max(known)[1] if known else None)


def test_operational_never_leaves_a_run(spark):
    mine = own(spark, *[("a", i, i + h, 5.0) for i in (1, 8, 200) for h in (1, 6)], ("b", 1, 2, 5.0))
    theirs = official(spark, ("a", "r", 0, 3, 1.0), ("a", "r", 0, 9, 7.0), ("a", "s", 6, 12, 0.0), ("a", "s", 6, 18, 6.0))
    rows = c.operational(mine, theirs, truth(spark, ("a", 7, 4.0)), (1, 6), lag=HOUR).collect()
    got = {(r.target_id, (r.issued_at - START).total_seconds() / 3600, r.horizon_hours): (r.run_id, r.official, r.how, r.age_hours) for r in rows}
    assert got == {
        ("a", 1, 1): ("r", None, None, 1.0),  # at 2, before the run's first point
        ("a", 1, 6): ("r", 5.0, "interpolated", 1.0),
        ("a", 8, 1): ("s", None, None, 2.0),
        ("a", 8, 6): ("s", 2.0, "interpolated", 2.0),
        ("a", 200, 1): ("s", None, None, 194.0),
        ("a", 200, 6): ("s", None, None, 194.0),
        ("b", 1, 1): (None, None, None, None),
        ("b", 1, 6): (None, None, None, None),
    }
    score = {r.horizon_hours: r for r in c.skill(c.operational(mine, theirs, truth(spark, ("a", 7, 4.0)), (1, 6), lag=HOUR), ["horizon_hours"]).collect()}
    assert (score[1].matched, score[1].own_mae, score[1].official_mae) == (0, None, None)
    assert (score[6].asked, score[6].matched, score[6].interpolated, score[6].own_mae, score[6].official_mae) == (4, 1, 1, 1.0, 1.0)


@pytest.mark.parametrize("cell", [HOUR, 10 * HOUR, 100 * DAY])
def test_event_scores(spark, cell):
    rng = random.Random(7)
    spans, at = [], 0
    for _ in range(12):
        at += rng.randint(5, 40)
        spans.append((at, at + rng.randint(0, 30)))
        at = spans[-1][1]
    warned = [(i, i, i + rng.randint(0, 24)) for i in sorted(rng.sample(range(at), 60))]
    w = spark.createDataFrame(
        [("a", hours(i), hours(f), hours(t)) for i, f, t in warned + warned[:5]] + [("b", hours(0), hours(0), hours(1)), ("a", hours(0), None, hours(1))],
        "target_id string, issued_at timestamp, from_at timestamp, to_at timestamp",
    )
    e = spark.createDataFrame(
        [("a", hours(s), hours(t)) for s, t in spans] + [("c", hours(0), hours(1))],
        "target_id string, started_at timestamp, last_above_at timestamp",
    )
    got = {r.target_id: r for r in v.event_scores(w, e, cell).collect()}
    firsts = [min([i for i, f, t in warned if f <= b and a <= t], default=None) for a, b in spans]
    leads = [a - first for (a, _), first in zip(spans, firsts) if first is not None and first < a]
    false = [1 for i, f, t in warned if not any(f <= b and a <= t for a, b in spans)]
    a = got["a"]
    assert (a.episodes, a.hits, a.missed) == (12, len(leads), firsts.count(None))
    assert (a.warnings, a.false_alarms) == (60, len(false))
    assert a.mean_lead_hours == pytest.approx(sum(leads) / len(leads)) and a.longest_lead_hours == max(leads)
    assert (got["b"].recall, got["b"].false_alarm_ratio) == (None, 1.0)
    assert (got["c"].recall, got["c"].false_alarm_ratio) == (0.0, None)


def test_exceedance(spark):
    df = spark.createDataFrame([(t, {"0.25": 1.0, "0.5": 2.0, "0.9": 6.0}) for t in (0.5, 1.0, 1.5, 4.0, 6.0, 9.0)], "t double, q map<string,double>")
    got = [r.p for r in df.select("t", v.exceedance(F.col("q"), F.col("t")).alias("p")).orderBy("t").collect()]
    assert got == pytest.approx([0.75, 0.75, 0.625, 0.3, 0.1, 0.1])


def test_brier_and_reliability(spark):
    rows = [("a", 0.05, False), ("a", 0.95, True), ("a", 1.0, False), ("a", None, True), ("a", 0.2, None), ("b", 0.3, False)]
    df = spark.createDataFrame(rows, "target_id string, p double, happened boolean")
    got = {r.target_id: r for r in v.brier_scores(df, ["target_id"]).collect()}
    assert got["a"].n == 3 and got["a"].brier == pytest.approx((0.0025 + 0.0025 + 1) / 3)
    assert got["a"].brier_climatology == pytest.approx(2 / 9) and got["b"].skill is None
    bins = {(r.target_id, r.bin): (r.n, r.observed_share) for r in v.reliability(df, ["target_id"]).collect()}
    assert bins == {("a", 0): (1, 0.0), ("a", 9): (2, 0.5), ("b", 3): (1, 0.0)}


def test_storm_blocks(spark):
    points = spark.createDataFrame([(hours(h),) for h in (0, 10, 20, 900)], "issued_at timestamp")
    storms = spark.createDataFrame([(hours(10), hours(800))], "started_at timestamp, ended_at timestamp")
    got = [r.block.split()[0] for r in v.storm_blocks(points, storms, cell=24 * HOUR).orderBy("issued_at").collect()]
    assert got == ["calendar", "storm", "storm", "calendar"]


def test_bootstrap_equals_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(h, f"b{rng.randint(0, 8)}", rng.randint(0, 64) / 32, rng.randint(0, 64) / 32) for h in (1, 6) for _ in range(60)]
    df = spark.createDataFrame(rows, "horizon_hours int, block string, candidate double, champion double")
    got = {r.horizon_hours: r for r in v.paired_bootstrap(df, replicates=50, seed="x").collect()}
    again = {r.horizon_hours: r for r in v.paired_bootstrap(df.repartition(7), replicates=50, seed="x").collect()}
    assert got == again

    def weight(block, replicate):
        u = (int(hashlib.sha256(f"x|{block}|{replicate}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        k, total = 0, math.exp(-1.0)
        while u > total:
            k += 1
            total += math.exp(-1.0) / math.factorial(k)
        return k

    for h in (1, 6):
        mine = [r for r in rows if r[0] == h]
        deltas = []
        for replicate in range(1, 51):
            drawn = [(weight(b, replicate), x - y) for _, b, x, y in mine]
            n = sum(w for w, _ in drawn)
            if n:
                deltas.append(sum(w * d for w, d in drawn) / n)
        upper = sorted(deltas)[math.ceil(0.95 * len(deltas)) - 1]
        mae = sum(y for *_, y in mine) / len(mine)
        assert got[h].upper == pytest.approx(upper) and got[h].champion_mae == pytest.approx(mae)
        assert got[h].non_inferior == (upper <= max(0.01, 0.01 * mae)) and got[h].pairs == 60
