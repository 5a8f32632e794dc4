import hashlib
import random

import numpy as np
from data import documents, empty, rows, words

from stagecast.llm import blocks
from stagecast.llm import fingerprints as fp


def test_span_hashes_and_common_extensions():
    rng = random.Random(1)
    one = "".join(rng.choice("ab") for _ in range(200))
    other = one[50:120] + "".join(rng.choice("ab") for _ in range(60))
    a, b = (fp.PREFIXES.arrays(fp.code_points([t])[0]) for t in (one, other))
    pairs = [(rng.randrange(200), rng.randrange(130)) for _ in range(300)] + [(50, 0), (60, 10)]
    x, y = (np.array(p) for p in zip(*pairs))

    def common(s, t):
        n = 0
        while n < min(len(s), len(t)) and s[n] == t[n]:
            n += 1
        return n

    assert fp.PREFIXES.common_extension(a, x, b, y).tolist() == [common(one[i:], other[j:]) for i, j in pairs]


def test_likeness_follows_the_common_part():
    rng = random.Random(2)
    text = words(rng, 800)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        cut = int(len(text) * share)
        other = text[:cut] + words(rng, 800)[: len(text) - cut]
        one, two = fp.sketches([text]), fp.sketches([other])
        got = float(fp.likeness(one, two)[0])
        assert abs(got - share) < 0.16
    assert fp.likeness(fp.sketches([""]), fp.sketches([""])).tolist() == [1.0]


def test_written_and_read():
    texts = ["", "a", "some text of some length", "é中😀" * 30]
    found = fp.sketches(texts)
    back = fp.read(fp.written(found))
    assert all(np.array_equal(a, b) for a, b in zip(found, back))
    assert fp.written(fp.sketches(texts[::-1])) == fp.written(found)[::-1]


def test_documents_in_order(spark, monkeypatch):
    for sampled in (1, 32):
        monkeypatch.setattr(blocks, "SAMPLED", sampled)
        found = {r.doc_id: r for r in fp.edits(documents(spark)).collect() if r.doc_id is not None}
        known = [(d, t or "") for d, t, *_ in rows() if d is not None and d not in (3, 5)]
        for (d, text), (e, following) in zip(known[:0:-1], known[-2::-1]):
            if d in (45, 44, 43, 42, 41, 40, *range(7, 40)) and e == d - 1:
                half = len(text) // 2
                want = text[: len(text) - half] + following[:half]
                assert found[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
                assert found[d].n_chars == len(text)
    assert len(fp.edits(documents(spark)).collect()) == len(rows())
    assert fp.edits(empty(spark)).collect() == []


def test_all_distinct_ids_against_a_plain_walk(spark):
    rng = random.Random(3)
    docs = [(i * 7 - 100, rng.choice([words(rng, rng.randrange(0, 60)), None])) for i in range(150)]
    found = {r.doc_id: r for r in fp.edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    walk = sorted(docs, reverse=True, key=lambda r: r[0])
    for (d, text), (_, following) in zip(walk, walk[1:] + walk[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        want = text[: len(text) - half] + following[:half]
        assert found[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert found[d].edited_fingerprint == fp.written(fp.sketches([want]))[0]
        assert found[d].near_next == float(fp.likeness(fp.sketches([text]), fp.sketches([following]))[0])


def test_common_ends_against_a_plain_walk(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["", "é", "ab", "b"]) + "ab" * rng.randrange(0, 40) + rng.choice(["", "b", "😀"])) for i in range(120)]
    found = {r.doc_id: r for r in fp.edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    walk = docs[::-1]
    for (d, text), (_, following) in zip(walk, walk[1:] + walk[:1]):
        r, edit = found[d], fp.edited(text, following)
        assert (r.prefix_edited, r.suffix_edited) == (common(text, edit), common(text[::-1], edit[::-1]))
        assert (r.prefix_next, r.suffix_next) == (common(text, following), common(text[::-1], following[::-1]))


def test_repeated_null_and_lone_ids(spark):
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    lone = fp.edits(make([(5, "hello world")])).collect()
    assert lone[0].edited_sha256 == hashlib.sha256(b"hello hello").hexdigest() and lone[0].near_next == 1.0
    nulls = fp.edits(make([(None, "abc"), (None, "xyzw")])).collect()
    assert sorted(r.n_chars for r in nulls) == [3, 4]
    same = fp.edits(make([(2, "twice"), (2, "twice"), (1, "one")])).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 2
    assert {r.row.row: r.fingerprint for r in fp.fingerprint(documents(spark)).collect()}[0]


def test_blocks_hold_consecutive_ids(spark):
    ids = spark.range(0, 1000).selectExpr("id * 3 as i").union(spark.createDataFrame([(None,)], "i long"))
    for descending in (False, True):
        found = blocks.in_blocks(ids, "i", descending=descending, heads=True).collect()
        own = [r for r in found if not r.copy]
        assert sorted(r.i for r in own if r.i is not None) == list(range(0, 3000, 3))
        nowhere = float("inf") if descending else float("-inf")
        order = sorted(own, key=lambda r: nowhere if r.i is None else -r.i if descending else r.i)
        assert [r.block for r in order] == sorted(r.block for r in order)
