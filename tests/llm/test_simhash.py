import random
import re

import numpy as np
import xxhash
from data import documents, empty, rows, words

from stagecast.llm import simhash
from stagecast.llm.graph import components


def slow_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(n, pairs):
    """Smallest member of each connected part, by repeated relabelling."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", " \n", "One", "one TWO", "a b c", "É é A b c d", words(rng, 500), "x " * 300]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_groups_against_all_pairs(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.randrange(0, 6)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                base ^= 1 << b
            fps.append(base)
    fps += [0, 1, (1 << 64) - 1, 0]
    n = len(fps)
    near = [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = parts(n, near)
    table = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "rid long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(table).collect()}
    assert [got[simhash.signed(f)] for f in fps] == want


def test_crowded_cells_are_cut_and_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(6)
    fps = sorted({rng.getrandbits(12) for _ in range(150)} | {rng.getrandbits(12) << 40 for _ in range(50)})
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = parts(len(fps), near)
    table = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "rid long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(table).collect()}
    assert [got[f] for f in fps] == want


def test_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 200, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    low = np.uint64(simhash.LOW)
    code = lambda x: ((x >> np.uint64(1) | x) & low) | ((x >> np.uint64(1) & x & low) << np.uint64(1))
    counts = lambda x: (x & low) + (x >> np.uint64(1) & low)
    for x, y in zip(a, b):
        fields = [abs(int(counts(x)) // 4**i % 4 - int(counts(y)) // 4**i % 4) for i in range(32)]
        assert sum(fields) == int(np.bitwise_count(code(x) ^ code(y))) <= int(np.bitwise_count(x ^ y))


def test_documents(spark):
    got = simhash.near_copies(documents(spark)).collect()
    assert len(got) == len(rows())
    known = rows()
    fps = [slow_fingerprint(r[1] or "") for r in known]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    low = parts(len(fps), near)
    smallest = {}
    for r, part in zip(known, low):
        if r[0] is not None:
            smallest[part] = min(smallest.get(part, r[0]), r[0])
    want = sorted(((r[0] is None, r[0] or 0, simhash.signed(f), smallest.get(p)) for r, f, p in zip(known, fps, low)), key=str)
    assert sorted(((r.rid is None, r.rid or 0, r.fp, r.component_id) for r in got), key=str) == want
    assert simhash.near_copies(empty(spark)).collect() == []


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(8)
    order = list(range(300))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 2000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
