import random
import re
from collections import Counter

import numpy as np
from data import documents, empty, rows, thue_morse, words

from stagecast.llm import substrings
from stagecast.llm.automaton import Automaton
from stagecast.llm.common import SpanHashes


def slow(texts, window):
    """Every window of every text counted as a tuple of words."""
    parts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in parts for i in range(len(w) - window + 1))
    out = []
    for w in parts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def check(spark, texts, ids=None):
    ids = ids or range(len(texts))
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(zip(ids, texts))], "doc_id long, text string, kept int")
    got = sorted(substrings.dedup(docs).collect(), key=lambda r: r.row.kept)
    assert [(r.kept, r.n_words, r.n_removed) for r in got] == slow(texts, substrings.WINDOW)


def test_shared_passages(spark):
    rng = random.Random(4)
    for letters in ("ab", "abcdefghij"):
        base = words(rng, 400, letters).split()
        texts = []
        for _ in range(50):
            own = words(rng, rng.randrange(0, 120), letters).split()
            at = rng.randrange(0, 330)
            own[len(own) // 2 : len(own) // 2] = base[at : at + rng.randrange(20, 70)]
            texts.append(rng.choice([" ", "\n", " \t "]).join(own))
        check(spark, [*texts, None, "", "  ", *texts[:3]], [*range(50), None, None, 3, 0, 7, 2])


def test_repeats_inside_one_text(spark):
    rng = random.Random(9)
    passage = words(rng, 40)
    check(spark, [f"{passage} mid {passage}", "a " * 200, "a " * 34, "a b " * 40, words(rng, 35)])


def test_window_on_the_edge(spark):
    rng = random.Random(10)
    passage = words(rng, 35)
    check(spark, [f"x {passage} y", f"z {passage}", passage.rsplit(" ", 1)[0] + " other"])


def test_copies_with_small_edits(spark):
    rng = random.Random(11)
    base = words(rng, 300).split()
    texts = [" ".join(base)] * 3
    for i in range(12):
        one = list(base)
        one[rng.randrange(len(one))] = f"edit{i}"
        texts.append(" ".join(one))
    check(spark, texts)


def test_words_that_collide(spark):
    common = words(random.Random(14), 34)
    for n in (512, 2048):
        one, two = thue_morse(n)
        check(spark, [f"{common} {one}", f"{common} {two}", f"{one} {common}", f"{two} {common}"])


def test_repeated_rows_add_no_hits(spark):
    rng = random.Random(15)
    text = words(rng, 200)
    other = text.split()
    other[100] = "changed"
    longest, spans = {}, SpanHashes()
    for copies in (2, 60):
        check(spark, [text] * copies + [" ".join(other)], [7] * copies + [8])
        docs = spark.createDataFrame([(7, text)] * copies + [(8, " ".join(other))], "doc_id long, text string")
        hits = substrings.places(docs.select("doc_id", "text"), spans=spans).select("hits").collect()
        longest[copies] = max(len(r.hits) for r in hits)
    assert longest[2] == longest[60]


def test_documents(spark):
    found = sorted(substrings.dedup(documents(spark)).collect(), key=lambda r: r.row.row)
    assert [(r.kept, r.n_words, r.n_removed) for r in found] == slow([r[1] for r in rows()], substrings.WINDOW)
    assert substrings.dedup(empty(spark)).collect() == []


def test_first_smallest():
    values = np.array([5, 3, 3, 9, 1, 1, 7, 2, 8], dtype=np.uint64)
    for width in range(1, 9):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert substrings.first_smallest(values, width).tolist() == want


def test_crowded_anchors_are_counted_by_window(spark, monkeypatch):
    rng = random.Random(13)
    passage = words(rng, 38)
    texts = [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(30)] + [f"{words(rng, 30)} {passage}"] * 2
    for crowded, shard in ((3, 100), (500, 100), (500, 20000)):
        monkeypatch.setattr(substrings, "CROWDED", crowded)
        monkeypatch.setattr(substrings, "SHARD", shard)
        check(spark, texts)


def test_automaton_counts_places():
    rng = random.Random(1)
    for _ in range(400):
        parts = [[rng.randrange(rng.choice((2, 3, 4))) for _ in range(rng.randrange(0, 14))] for _ in range(rng.randrange(1, 6))]
        automaton, least = Automaton(parts), rng.randrange(1, 5)
        seen = Counter(tuple(p[i : i + least]) for p in parts for i in range(len(p) - least + 1))
        for p in [*parts, [rng.randrange(5) for _ in range(9)]]:
            want = [i + least for i in range(len(p) - least + 1) if seen[tuple(p[i : i + least])] >= 2]
            assert automaton.repeated_ends(p, least) == want
