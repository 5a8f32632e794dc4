import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from data import documents, empty, rows

from stagecast.llm import languages


def slow(docs):
    """The same model with plain dictionaries; docs are (doc_id, text, lang)."""
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for doc_id, text, lang in docs:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            found = languages.words_of(text or "")
            words[lang].update(found)
            for w in found:
                for n in range(1, languages.LONGEST + 1):
                    padded = w if n == 1 else f" {w} "
                    for i in range(len(padded) - n + 1):
                        grams[n][lang][padded[i : i + n]] += 1
    langs = sorted(lang for lang in words if words[lang])
    known = {w for lang in langs for w in words[lang]}
    every = {n: {g for lang in langs for g in grams[n][lang]} for n in grams}

    def log(count, total, size):
        return math.floor(math.log((count + languages.SMOOTHING) / (total + languages.SMOOTHING * size)) * languages.UNIT + 0.5)

    def score(w, lang):
        if w in known:
            return log(words[lang][w], sum(words[lang].values()), len(known))
        for n in range(languages.LONGEST, 0, -1):
            padded = w if n == 1 else f" {w} "
            met = [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] in every.get(n, ())]
            if met:
                total = sum(grams[n][lang].values())
                return sum(log(grams[n][lang][g], total, len(every[n])) for g in met) / len(met)
        return 0

    out = []
    for _, text, _ in docs:
        found = languages.words_of(text or "")
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        sums = [sum(score(w, lang) for w in found) for lang in langs]
        top = max(sums)
        out.append((langs[sums.index(top)], 1 / sum(math.exp((x - top) / languages.UNIT) for x in sums)))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "жзийк", "dd": "中文字"}
    out = []
    for i in range(n):
        lang = rng.choice(list(letters))
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15)))
        out.append((i, text.title() if i % 3 else text + "! 12 ½", None if i % 17 == 0 else lang))
    return out + [(n, "qqq zzzz", "aa"), (n + 1, "12 ½ ²", "aa"), (n + 2, None, "bb"), (None, "abc ж", "cc"), (n + 3, "", None)]


@pytest.mark.parametrize("sent", [1 << 18, 40, 0])
def test_same_as_plain_counts(spark, monkeypatch, sent):
    monkeypatch.setattr(languages, "SENT", sent)
    docs = texts(sent, 120)
    docs += docs[:9] + docs[-4:]
    table = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, lang string, sums int")
    found = languages.predict(table, languages.learn(table)).collect()
    got = sorted(((str(r.rid), r.lang_pred, r.score) for r in found), key=str)
    want = sorted(((str(d[0]), *s) for d, s in zip(docs, slow(docs))), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def test_words():
    assert languages.words_of("Don't STOP12 m² ½ ² É_é") == ["don", "t", "stop", "m²", "é", "é"]
    assert [languages.grams_of("ab", n) for n in range(1, 6)] == [["a", "b"], [" a", "ab", "b "], [" ab", "ab "], [" ab "], []]


def test_rows_and_nothing_learned(spark):
    found = languages.predict(documents(spark), languages.learn(documents(spark))).collect()
    assert len(found) == len(rows())
    none = documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in languages.predict(none, languages.learn(none)).collect()} == {("und", 0.0)}
    assert languages.predict(empty(spark), languages.learn(empty(spark))).collect() == []


def test_held_out_documents(spark):
    """Held-out documents of the given table keep their language."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    found = languages.op13_language_id(spark, folder).filter("held_out")
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    hits = found.join(lang, "doc_id").selectExpr("avg(cast(lang = lang_pred as double)) as share").first()
    assert hits.share > 0.98
