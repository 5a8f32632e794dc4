"""Live views against batch forms, restarts, late rows; triggers and risk events against loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagecast.constants import MINUTE
from stagecast.operators.triggers import coalesced_triggers, risk_events
from stagecast.streaming import live

START = datetime(2026, 1, 1)


def minutes(n):
    return START + timedelta(minutes=n)


def groups(found):
    return sorted((r.target_id, r.first_at, r.last_at, r.triggers, tuple(r.kinds)) for r in found.collect())


def plain_groups(rows, gap=5):
    out = []
    for target in sorted({t for t, _, _ in rows}):
        mine = sorted((m, k) for t, m, k in rows if t == target)
        start = 0
        for i in range(1, len(mine) + 1):
            if i == len(mine) or mine[i][0] - mine[i - 1][0] > gap:
                part = mine[start:i]
                out.append((target, minutes(part[0][0]), minutes(part[-1][0]), len(part), tuple(sorted({k for _, k in part}))))
                start = i
    return sorted(out)


def trigger_rows(seed, n=300, span=3000):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randint(0, span), rng.choice(("hourly", "batch"))) for _ in range(n)]


def triggers(spark, rows):
    return spark.createDataFrame([(t, minutes(m), k) for t, m, k in rows], live.TRIGGER)


@pytest.mark.parametrize("width", [MINUTE, 7 * MINUTE, 100_000 * MINUTE])
def test_coalesced_triggers(spark, width):
    rows = trigger_rows(1)
    assert groups(coalesced_triggers(triggers(spark, rows), width=width)) == plain_groups(rows)


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = sorted(trigger_rows(2), key=lambda r: r[1])
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for part in (rows[:100], rows[100:200], rows[200:]):  # a restart after every part
        triggers(spark, part).coalesce(1).write.mode("append").parquet(path)
        live.run_view(live.live_sessions(live.landed(spark, path, live.TRIGGER)), out, checkpoint)
    closed = minutes(rows[-1][1]) - timedelta(hours=2)
    want = [g for g in plain_groups(rows) if g[2] + timedelta(minutes=5) <= closed]
    assert len(want) > 50 and groups(spark.read.parquet(out)) == want


def test_windows_and_late_rows(spark, tmp_path):
    rng = random.Random(5)
    parts = [[(rng.choice("ab"), rng.randint(lo, hi), float(rng.randint(0, 9))) for _ in range(80)] for lo, hi in ((0, 600), (500, 1400), (0, 1500))]
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    tagged = None
    for batch, part in enumerate(parts):
        df = spark.createDataFrame([(g, minutes(m), x) for g, m, x in part], live.READING)
        df.coalesce(1).write.mode("append").parquet(path)
        live.run_view(live.live_windows(live.landed(spark, path, live.READING)), out, checkpoint)
        df = df.withColumn("batch_id", F.lit(batch))
        tagged = df if tagged is None else tagged.unionByName(df)
    late, mark = set(), -1
    for batch, part in enumerate(parts):
        late |= {(batch, i) for i, (_, m, _) in enumerate(part) if (m // 60 + 1) * 60 <= mark}
        mark = max(mark, max(m for _, m, _ in part) - 120)
    assert late and live.late_rows(tagged).count() == len(late)
    want = {}
    for batch, part in enumerate(parts):
        for i, (g, m, x) in enumerate(part):
            if (batch, i) not in late and (m // 60 + 1) * 60 <= mark:
                want.setdefault((g, minutes(m // 60 * 60)), []).append(x)
    got = {(r.gauge_id, r.starts_at): (r.readings, r.most) for r in spark.read.parquet(out).collect()}
    assert got == {k: (len(xs), max(xs)) for k, xs in want.items()}


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_risk_events(spark, width):
    rng = random.Random(11)
    rows = [(t, i, rng.choice((True, True, False, False, None))) for t in "ab" for i in range(200)]
    df = spark.createDataFrame([(t, minutes(60 * i), a) for t, i, a in rows], "target_id string, issued_at timestamp, above boolean")
    got = sorted((r.target_id, r.issued_at, r.transition) for r in risk_events(df, F.col("above"), width=width).collect())
    want = []
    for target in "ab":
        is_open, up, down = False, 0, 0
        for _, i, above in (r for r in rows if r[0] == target and r[2] is not None):
            up, down = (up + 1, 0) if above else (0, down + 1)
            if not is_open and up >= 2:
                is_open = True
                want.append((target, minutes(60 * i), "risk_opened"))
            elif is_open and down >= 3:
                is_open = False
                want.append((target, minutes(60 * i), "risk_closed"))
    assert want and got == sorted(want)
