import random
import zlib

import numpy as np
from data import documents, empty, rows, words
from pyspark.sql import functions as F

from stagecast.llm import quality


def texts(seed, n):
    """Plain prose, and the same in capitals or with odd marks."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = words(rng, rng.randrange(5, 120), "aeioustrnlm")
        good = i % 3 > 0
        if not good:
            text = text.upper() if i % 2 else " ".join(w + "###" for w in text.split())
        out.append((text.encode(), int(good)))
    return out


def scores(net, found):
    bounds = np.cumsum([0, *map(len, found)])
    return net.scores(*quality.half_chunks(np.frombuffer(b"".join(found), np.uint8), bounds))


def test_learns_and_generalises():
    learn, other = texts(1, 240), texts(2, 150)
    net = quality.train([t for t, _ in learn], np.array([y for _, y in learn]))
    got = scores(net, [t for t, _ in other])
    assert ((got >= quality.THRESHOLD) == [y for _, y in other]).mean() > 0.95


def test_gradient():
    draw = np.random.default_rng(0)
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = draw.integers(0, 256, 900).astype(np.uint8)
    symbols, ends = quality.half_chunks(raw, np.array([0, 400, 400, 900]))
    good, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = net.forward(symbols, ends)
        return (weight * (np.logaddexp(0, z) - good * z)).sum() / 3

    g = net.gradient(symbols, ends, good, weight)
    for name, v in net.p.items():
        for _ in range(5):
            at = tuple(draw.integers(0, n) for n in v.shape)
            if name == "tables":
                at = (at[0], int(raw[draw.integers(0, 900)]), at[2])
            old, step = v[at], 1e-5
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4 + 0.02 * abs(g[name][at])


def test_whole_text_counts_wherever_it_is_cut():
    net = quality.Network(1)
    found = [b"", b"x", b"a" * 127, b"b" * 128, b"c" * 129, bytes(range(256)) * 9]
    one = scores(net, found)
    assert np.allclose(one, [scores(net, [t])[0] for t in found])
    symbols, ends = quality.half_chunks(np.frombuffer(found[-1], np.uint8), np.array([0, len(found[-1])]))
    assert symbols[:, : quality.HALF].reshape(-1).tolist()[: len(found[-1])] == list(found[-1])
    changed = found[-1][:-1] + b"!"
    logit = lambda t: net.forward(*quality.half_chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0]
    assert logit(changed) != logit(found[-1])


def test_one_class_or_none():
    for good, want in (([], True), ([1, 1], True), ([0], False)):
        net = quality.train([b"text"] * len(good), np.array(good, dtype=int))
        assert (scores(net, [b"other"])[0] >= quality.THRESHOLD) == want


def test_sample_leaves_out_what_is_held_out(spark):
    labels = spark.createDataFrame(
        [(r[0], r[0] % 2, 0) for r in rows() if r[0] is not None and r[0] < 40] + [(7, 0, 0), (None, 1, 0), (8, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    found, good = quality.sample(documents(spark), labels)
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and len(found) == len(good) == 40 - len(held) - (7 not in held)
    one = documents(spark).filter(quality.held_out(F.col("doc_id")))
    assert sorted({r.doc_id for r in one.collect() if r.doc_id < 40}) == held


def test_long_texts_are_learned_from_to_their_end(spark):
    rng = random.Random(3)
    clean = [words(rng, 9000, "aeioustrnlm") for _ in range(40)]
    docs = [(i, t if i % 2 else t[: 2 * len(t) // 3] + t[2 * len(t) // 3 :].upper(), i % 2) for i, t in enumerate(clean)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    found, good = quality.sample(df, df)
    whole = [any(c.isupper() for c in b"".join(runs).decode()) for _, runs, _ in found]
    assert all(len(t) > 30000 for t in clean) and whole == [not y for y in good]
    net = quality.classifier(df, df)
    got = {r.row.doc_id: r.score for r in quality.score(df, net).collect()}
    assert all((got[i] >= quality.THRESHOLD) == bool(y) for i, _, y in docs)
    rows = quality.chosen(df, df)
    ids = sorted(r.doc_id for r in rows.collect())
    assert np.allclose(1 / (1 + np.exp(-quality.whole_logits(rows, net, ids) - net.shift)), [got[i] for i in ids])


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    held = [i for i in range(12) if zlib.crc32(str(i).encode()) % 4 == 2]
    found, good = quality.sample(docs, labels, per_class=12)
    assert len(found) == 12 - len(held) and set(good.tolist()) == {0, 1}


def test_rows(spark):
    net = quality.Network(2)
    found = quality.score(documents(spark), net).collect()
    assert sorted(r.row.row for r in found) == [r[5] for r in rows()]
    texts = {r.row.row: r.score for r in found}
    assert all(0 <= s <= 1 for s in texts.values())
    assert texts[40] == texts[42] == texts[43]  # null and empty texts
    assert quality.score(empty(spark), net).collect() == []
