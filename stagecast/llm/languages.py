"""Language identification: known words by their frequencies, others by shorter and shorter n-grams.

A word that was learned has for each language the logarithm of its smoothed share of the
language's words. A word that was not is cut into its n-grams of the greatest length, of at most
LONGEST characters, of which any was learned, and has the mean of their logarithms. A text's
score for a language is the sum over its words; the language with the largest sum wins.

All counts cover all learned texts and are sums in tables. Words that occur often are scored
where the text is read, out of a table of bounded size; the other words of a text are joined
with the table of all words. Scores are whole multiples of 2**-20, so sums do not depend on
the order in which they are made.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import query, row_key, small_batches, table, whole_text
from stagecast.session import materialise

LONGEST = 4
#: Added to every count, so that no share is zero.
SMOOTHING = 0.5
UNIT = 1 << 20
UNKNOWN = "und"
#: Words scored where the text is read, at most, and their scores over all languages; their characters.
SENT, SENT_SCORES, SENT_LENGTH = 1 << 19, 1 << 22, 64
#: Distinct (language, word) pairs a task counts before it hands them on.
HELD = 400_000

RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; a run may hold signs that count as numbers, but needs a letter."""
    found = RUN.findall(text.lower())
    if text.isascii():
        return found
    return [w for w in found if w.isascii() or any(c.isalpha() for c in w)]


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between two spaces; single characters without the spaces."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def held_out(ident: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _totals(counter_of):
    """Counts of (word, lang) per task; ``counter_of`` adds a batch to a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}

        def done():
            for lang, own in counts.items():
                yield pa.record_batch(
                    {
                        "word": pa.array(own.keys(), pa.string()),
                        "lang": pa.array([lang] * len(own), pa.string()),
                        "n": pa.array(own.values(), pa.int64()),
                    }
                )
            counts.clear()

        for batch in batches:
            counter_of(counts, batch)
            if sum(map(len, counts.values())) > HELD:
                yield from done()
        yield from done()

    return run


def _add_words(counts: dict, batch: pa.RecordBatch) -> None:
    for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
        counts.setdefault(lang, Counter()).update(words_of(text))


def _add_grams(counts: dict, batch: pa.RecordBatch) -> None:
    for word, lang, n in zip(*(batch.column(c).to_pylist() for c in ("word", "lang", "n"))):
        own = counts.setdefault(lang, Counter())
        for size in range(1, LONGEST + 1):
            for gram in grams_of(word, size):
                own[gram] += n


def _grams(n: int):
    """(word, gram, times): the n-grams of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            found = [Counter(grams_of(word, n)) for word in words]
            yield pa.record_batch(
                {
                    "word": pa.array([w for w, own in zip(words, found) for _ in own], pa.string()),
                    "gram": pa.array([g for own in found for g in own], pa.string()),
                    "times": pa.array([n for own in found for n in own.values()], pa.int64()),
                }
            )

    return run


class Model(NamedTuple):
    """The languages in order of code points, and (word, scores, often) for every word of the corpus."""

    langs: list[str]
    words: DataFrame | None = None


def _scores(counted: DataFrame, level: Column, langs: list[str]) -> DataFrame:
    """(key, level, scores): a score for each language from counts (key, lang, n).

    Shares are taken among the keys of a level, of which there are a handful.
    """
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    rows = materialise(counted.withColumn("level", level).groupBy("key", "level").agg(by_lang.alias("by_lang")), "counts")
    per_lang = [F.sum(F.coalesce(F.col("by_lang")[lang], F.lit(0))) for lang in langs]
    sizes = rows.groupBy("level").agg(F.count("*").alias("keys"), F.array(*per_lang).alias("totals")).collect()
    below = {r.level: [n + SMOOTHING * r.keys for n in r.totals] for r in sizes}
    shares = F.array(*[F.array(*[F.lit(float(x)) for x in below.get(k, [1.0] * len(langs))]) for k in range(LONGEST + 1)])
    order = F.array(*[F.lit(lang) for lang in langs])

    def one(lang, i):
        share = (F.coalesce(F.col("by_lang")[lang], F.lit(0)) + SMOOTHING) / F.get(F.get(shares, F.col("level")), i)
        return F.round(F.log(share) * UNIT).cast("long")

    return rows.select("key", "level", F.transform(order, one).alias("scores"))


def learn(docs: DataFrame) -> Model:
    """A model of the languages of documents (doc_id, text, lang), from the rows that are not held out.

    A row teaches if its id, text and language are not null. Words of the other rows are
    listed as well, so that unseen words are scored once each and not once a document.
    """
    small_batches(docs.sparkSession)
    teaches = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    plain = docs.select(whole_text().alias("text"), F.when(teaches, F.col("lang").cast("string")).alias("lang"))
    counted = plain.mapInArrow(_totals(_add_words), "word string, lang string, n long")
    counted = materialise(counted.groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")
    learned = counted.filter("lang is not null")
    langs = sorted(r.lang for r in learned.select("lang").distinct().collect())
    if not langs:
        return Model([])
    known = _scores(learned.select(F.col("word").alias("key"), "lang", "n"), F.lit(0), langs)
    known = known.select(F.col("key").alias("word"), "scores")
    totals = counted.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.col("lang").isNotNull()).alias("known"))
    totals = materialise(totals, "word-totals")

    grams = learned.mapInArrow(_totals(_add_grams), "word string, lang string, n long")
    grams = grams.groupBy(F.col("word").alias("key"), "lang").agg(F.sum("n").alias("n"))
    grams = _scores(grams, F.length("key"), langs)
    grams = grams.withColumnRenamed("key", "gram")
    words, left = known, totals.filter("not known").select("word")
    sums = F.array(*[F.sum(F.col("times") * F.get("scores", F.lit(i))) for i in range(len(langs))])
    for n in range(LONGEST, 0, -1):
        asked = left.mapInArrow(_grams(n), "word string, gram string, times long")
        met = asked.join(grams.filter(F.col("level") == n), "gram")
        met = met.groupBy("word").agg(F.sum("times").alias("weight"), sums.alias("sums"))
        mean = F.transform("sums", lambda x: F.round(x / F.col("weight")).cast("long"))
        met = materialise(met.select("word", mean.alias("scores")), "unseen")
        words = words.unionByName(met)
        left = materialise(left.join(met.select("word"), "word", "left_anti"), "left")

    step = F.floor(F.log2("total") * 8).cast("int")
    short = totals.filter(F.length("word") <= SENT_LENGTH)
    steps = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)
    room, least = min(SENT, SENT_SCORES // len(langs)), None
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    often = (F.length("word") <= SENT_LENGTH) & (step >= least) if least is not None else F.lit(False)
    return Model(langs, materialise(words.join(totals.select("word", often.alias("often")), "word"), "word-scores"))


def _scored(often, n_langs: int):
    """Sums over the words of the broadcast table, and the other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, matrix = often.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            sums = np.zeros((len(batch), n_langs), dtype=np.int64)
            letters, rest = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = Counter(words_of(text))
                letters.append(bool(found))
                at = [number.get(w) for w in found]
                rest.append([(w, n) for (w, n), k in zip(found.items(), at) if k is None])
                times = np.array([n for n, k in zip(found.values(), at) if k is not None], dtype=np.int64)
                if len(times):
                    sums[i] = times @ matrix[[k for k in at if k is not None]]
            flat = pa.array(sums.ravel())
            ends = np.arange(len(batch) + 1, dtype=np.int32) * n_langs
            more = np.cumsum([0, *map(len, rest)]).astype(np.int32)
            pairs = [pa.array([x[j] for r in rest for x in r], t) for j, t in enumerate((pa.string(), pa.int32()))]
            rows = batch.drop_columns(["text"]).append_column("letters", pa.array(letters))
            rows = rows.append_column("uid", pa.array(np.arange(uid, uid + len(batch))))
            uid += len(batch)
            rows = rows.append_column("sums", pa.ListArray.from_arrays(pa.array(ends), flat))
            yield rows.append_column("rest", pa.ListArray.from_arrays(pa.array(more), pa.StructArray.from_arrays(pairs, ["word", "n"])))

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(rid, rhash, lang_pred, score) for every row of documents (doc_id, text).

    ``score`` is the winner's share of the likelihood; of equal languages the first by code
    point wins. Texts that are null or without a letter, and all texts where nothing was
    learned, are ``und`` with score 0. Repeated rows each get a row; rows are numbered in the
    table that the sums are written to. Words that are not in
    the broadcast table are joined by word; the table's size is bounded by SENT and
    SENT_SCORES, whatever the number of words.
    """
    spark = small_batches(docs.sparkSession)
    langs, n = model.langs, len(model.langs)
    rows = docs.select(*row_key(), whole_text().alias("text"))
    if not n:
        return rows.select("rid", "rhash", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    table_of = model.words.filter("often").select("word", "scores").toArrow()
    matrix = table_of.column("scores").combine_chunks().flatten().to_numpy().reshape(-1, n)
    number = {w: i for i, w in enumerate(table_of.column("word").to_pylist())}
    sent = spark.sparkContext.broadcast((number, matrix))
    kind = rows.schema["rid"].dataType.simpleString()
    scored = rows.mapInArrow(
        _scored(sent, n), f"rid {kind}, rhash long, letters boolean, uid long, sums array<long>, rest array<struct<word:string,n:int>>"
    )
    scored = materialise(scored, "scored")
    rest = scored.select("uid", F.explode("rest").alias("e")).select("uid", "e.*")
    met = rest.join(model.words.filter("not often").select("word", "scores"), "word")
    more = [F.sum(F.col("n") * F.get("scores", F.lit(i))) for i in range(n)]
    met = met.groupBy("uid").agg(F.array(*more).alias("more"))
    whole = scored.drop("rest").join(met, "uid", "left")
    whole = whole.withColumn("sums", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y)))
    top = F.array_max("sums")
    share = F.aggregate("sums", F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / UNIT))
    order = F.array(*[F.lit(lang) for lang in langs])
    return whole.select(
        "rid",
        "rhash",
        F.when(F.col("letters"), F.get(order, F.array_position("sums", top).cast("int") - 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), 1 / share).otherwise(0.0).alias("score"),
    )


@query()
def op13_language_id(spark, sf_dir):
    """The language of every document of ``documents``, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return found.select(F.col("rid").alias("doc_id"), held_out(F.col("rid")).alias("held_out"), "lang_pred", "score")
