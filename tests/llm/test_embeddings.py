import numpy as np

from stagecast.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, vector int, size int"


def slow(rows):
    """Links and components by comparing all rows."""
    usable = [
        r[1] is not None and r[2] is not None and len(r[1]) > 0
        and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
        for r in rows
    ]
    n, links = len(rows), [0] * len(rows)
    low = [r[0] for r in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= embeddings.THRESHOLD:
                    pairs.append((i, j))
                    links[i] += 1
                    links[j] += 1
    for _ in range(n):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return sorted((r[0], k, c, r[0] == c) for r, k, c in zip(rows, links, low))


def vectors(seed, groups=12):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = draw.normal(size=24)
        for _ in range(draw.integers(1, 9)):
            v = centre + draw.normal(size=24) * draw.choice([0, 0.05, 0.12])
            rows.append((v.astype(np.float32).tolist(), int(g % 3)))
    first = rows[0][0]
    rows += [(first, rows[0][1])] * 5 + [(first, 7), (first, None), (None, 1), ([], 1), ([0.0] * 24, 0)]
    rows += [([float("nan")] * 24, 0), ([float("inf")] * 24, 0), ([None] * 24, 0), (first[:5], 0), ([-0.0, 1.0], 0), ([0.0, 1.0], 0)]
    return [(i, v, label, "clash", i, i) for i, (v, label) in enumerate(rows)]


def got(spark, rows):
    found = embeddings.near_copies(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in found.collect())


def test_against_all_pairs(spark):
    rows = vectors(1)
    assert got(spark, rows) == slow(rows)


def test_crowded_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 6)
    rows = vectors(2, groups=6)
    assert got(spark, rows) == slow(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_recall_at_the_threshold():
    """Pairs right at the threshold meet in some table nearly always."""
    draw = np.random.default_rng(3)
    a = draw.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = embeddings.THRESHOLD
    met = (embeddings.signatures(a) == embeddings.signatures(c * a + np.sqrt(1 - c * c) * b)).any(axis=1)
    assert met.mean() > 0.99
