"""Grouped boosting against a plain histogram booster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecast.operators import boosting

HORIZONS = (1, 6)


def examples(spark, targets=("a", "b", "c"), n=160, width=6, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for t, name in enumerate(targets):
        x = np.round(draw.normal(size=(n, width)) * 4) / 4
        for i in range(n):
            y1 = x[i, -1] + 2.0 * (x[i, 0] > x[i, -1]) + 0.25 * t
            y6 = x[i, -1] + float(np.round(draw.normal() * 8)) / 8 + (x[i, 1] - x[i, -1]) * (t + 1) / 2
            rows.append((name, i, ("training", "training", "validation", "calibration")[i % 4], x[i].tolist(), float(y1), float(y6)))
    return spark.createDataFrame(rows, "target_id string, issued_idx long, split string, history array<double>, y_1 double, y_6 double")


def plain(rows, column, trees, depth, step, bins, patience, least, ridge):
    """One target and horizon at a time, every cut tried in turn."""
    x = np.array([np.array(r.history) - r.history[-1] for r in rows])
    change = np.array([r[column] - r.history[-1] for r in rows])
    train, valid = (np.array([r.split == s for r in rows]) for s in ("training", "validation"))
    edges = [sorted({float(np.quantile(x[train][:, f], i / bins)) for i in range(1, bins)}) for f in range(x.shape[1])]
    fixed = lambda v: np.rint(v * boosting.UNIT)
    fit = np.full(len(rows), fixed(change[train]).sum() / (train.sum() * boosting.UNIT))
    found, best, best_tree = [], fixed((change - fit)[valid] ** 2).sum(), 0
    for tree in range(1, trees + 1):
        g = fixed(change - fit)
        node, value = np.ones(len(rows), int), np.zeros(len(rows))
        for level in range(depth):
            for k in range(1 << level, 2 << level):
                here = train & (node == k)
                whole, n = g[here].sum() / boosting.UNIT, here.sum()
                top = None
                for f in range(x.shape[1]):
                    for b, edge in enumerate(edges[f]):
                        low = here & (x[:, f] <= edge)
                        gl, nl = g[low].sum() / boosting.UNIT, low.sum()
                        if nl < least or n - nl < least:
                            continue
                        gr, nr = whole - gl, n - nl
                        gain = round(gl**2 / (nl + ridge) + gr**2 / (nr + ridge) - whole**2 / (n + ridge), 9)
                        if gain > 0 and (top is None or gain > top[0]):
                            top = (gain, f, edge, step * gl / (nl + ridge), step * gr / (nr + ridge))
                live = node == k
                if top is None:
                    node[live] = 0
                    continue
                _, f, edge, left, right = top
                found.append((tree, k, f, edge, left, right))
                goes = x[:, f] <= edge
                value[live] = np.where(goes, left, right)[live]
                node[live] = (2 * k + ~goes)[live]
        fit = fit + value
        error = fixed((change - fit)[valid] ** 2).sum()
        if error < best:
            best, best_tree = error, tree
        if tree - best_tree >= patience:
            break
    return [c for c in found if c[0] <= best_tree]


@pytest.fixture(scope="module")
def settings():
    return {"trees": 4, "depth": 2, "step": 0.5, "bins": 8, "patience": 2, "least": 5, "ridge": 1.0}


def test_same_cuts_as_a_plain_booster(spark, settings):
    rows = examples(spark)
    grown = boosting.grow(rows, HORIZONS, rows_share=1.0, features_share=1.0, **settings)
    got = {}
    for r in grown.where("tree > 0").collect():
        got.setdefault((r.target_id, r.horizon), []).append((r.tree, r.node, r.feature, r.threshold, r.left, r.right))
    for name in "abc":
        mine = [r for r in rows.orderBy("issued_idx").collect() if r.target_id == name]
        for h in HORIZONS:
            want = plain(mine, f"y_{h}", **settings)
            have = sorted(got.get((name, h), []))
            assert [c[:3] for c in have] == [c[:3] for c in want]
            assert np.allclose([c[3:] for c in have], [c[3:] for c in want]) if want else not have


def test_scores_follow_the_cuts(spark, settings):
    rows = examples(spark)
    grown = boosting.grow(rows, HORIZONS, **settings)
    cuts = {(r.target_id, r.horizon, r.tree, r.node): r for r in grown.collect()}
    last = {(t, h): max(k[2] for k in cuts if k[:2] == (t, h)) for t, h, *_ in cuts}
    found = boosting.score(rows, grown, HORIZONS).collect()
    assert len(found) == rows.count()
    for r in found:
        x = [v - r.history[-1] for v in r.history]
        for h in HORIZONS:
            total = 0.0
            for tree in range(last[r.target_id, h] + 1):
                node, value = 1, 0.0
                while (cut := cuts.get((r.target_id, h, tree, node))) is not None:
                    goes = x[cut.feature] <= cut.threshold
                    node, value = 2 * node + (not goes), cut.left if goes else cut.right
                    if tree == 0:
                        break
                total += value
            assert r[f"p_{h}"] == pytest.approx(r.history[-1] + total)


def test_targets_stop_apart_and_runs_agree(spark, settings):
    rows = examples(spark)
    both = boosting.grow(rows.where("target_id <> 'a'"), HORIZONS, **settings).collect()
    rounds = {}
    for r in both:
        rounds[r.target_id, r.horizon] = max(rounds.get((r.target_id, r.horizon), 0), r.tree)
    assert len(set(rounds.values())) > 1
    alone = boosting.grow(rows.where("target_id = 'b'"), HORIZONS, **settings).collect()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in both if r.target_id == "b")


def test_targets_without_an_ensemble(spark, settings):
    rows = examples(spark)
    grown = boosting.grow(rows.where("target_id = 'a'"), HORIZONS, **settings | {"trees": 1})
    found = boosting.score(rows, grown, HORIZONS, how="left").groupBy("target_id").agg(F.count("p_1").alias("n")).collect()
    assert {r.target_id: r.n > 0 for r in found} == {"a": True, "b": False, "c": False}
