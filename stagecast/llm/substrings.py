"""Substring dedup: words covered by a window of words that also starts elsewhere go.

Every window names an anchor: the run of ANCHOR words inside it whose hash is smallest, the
first of equals. Equal windows have equal anchors in the same place, so only windows whose
anchors repeat need a closer look. The consecutive windows of one anchor are a segment. A
segment that occurs twice as a whole is repeated window by window. The others go, with one
copy of what they may share, to reference shards: all segments of an anchor meet in one shard,
a suffix automaton is built over a shard's words, and the segments are streamed through it for
matching statistics; what matches over WINDOW words in two places is repeated.

A broadcast of the shards to all documents would grow with the corpus in size and in passes;
since an anchor names the one shard that can hold a match, segments are dealt to it instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.automaton import Automaton
from stagecast.llm.common import (
    SpanHashes,
    cuts,
    lists,
    mix64,
    query,
    row_key,
    small_batches,
    table,
    text_slices,
    whole_text,
    word_spans,
)
from stagecast.session import materialise

WINDOW, ANCHOR = 35, 12
SLICE = 1 << 20
#: Words of a reference shard, and distinct segments of an anchor up to which they share one;
#: windows of more crowded anchors are counted by hash.
SHARD, CROWDED = 20_000, 500
#: How a segment is dealt with: repeated as a whole, window by window, or as a whole while its
#: anchor has other segments that are looked at window by window.
WHOLE, SINGLE, BOTH = 0, 1, 2


def word_hashes(raw: np.ndarray, bounds: np.ndarray, spans: SpanHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows, and the rows' bounds in them."""
    starts, stops, edges = word_spans(raw, bounds)
    return mix64(spans.of(raw, starts, stops)), edges


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the first smallest value's place among ``width`` places from it on."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        one, two = place[: len(place) - step], place[step:]
        place = np.where(values[one] <= values[two], one, two)
        have += step
    return place


def segments(words: np.ndarray, edges: np.ndarray, spans: SpanHashes, window: int = WINDOW):
    """(row, anchor hash, segment hash, first window, windows) of all segments of some rows.

    Windows are numbered by their first word within the row.
    """
    width = window - ANCHOR + 1
    n = len(words) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    at = np.arange(len(words) - ANCHOR + 1)
    grams = mix64(spans.of(words, at, at + ANCHOR))
    anchor = first_smallest(grams, width)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = np.nonzero(row[:n] == row[window - 1 :])[0]
    anchor = anchor[inside]
    change = np.ones(len(inside), dtype=bool)
    change[1:] = anchor[1:] != anchor[:-1]
    heads = np.nonzero(change)[0]
    counts = np.diff(np.append(heads, len(inside)))
    first, anchor = inside[heads], anchor[heads]
    whole = spans.of(words, first, first + counts + window - 1)
    shape = (anchor - first).astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64)
    return row[first], grams[anchor], mix64(whole + mix64(shape)), first - edges[row[first]], counts


def _scan(window: int, spans: SpanHashes, full: bool):
    """Segments of each row: with ``full`` where they are, else only what is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                row, anchor, segment, first, count = segments(*word_hashes(raw, bounds, spans), spans, window)
                found = {"anchor": anchor.view(np.int64), "segment": segment.view(np.int64)}
                names = ("rid", "rhash", "rk") if full else ("rk",)
                found |= {k: rows.column(k).take(pa.array(row)) for k in names}
                if full:
                    found |= {"first": first.astype(np.int32), "n": count.astype(np.int32)}
                yield pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in found.items()})

    return run


def _apart(window: int, spans: SpanHashes):
    """What has to be looked at beyond whole segments: segments with their words, or windows.

    Segments of crowded anchors give a row for each window, with its hash, others one row with
    their words' hashes. Of equal segments of kind BOTH in a row one is enough, and so is one of
    repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                fresh = [k not in done and not done.add(k) for k in zip(*(rows.column(c).to_pylist() for c in ("rid", "rhash")))]
                lists_of = zip(fresh, rows.column("hits").to_pylist())
                hits = [(i, h) for i, (new, hs) in enumerate(lists_of) if new for h in hs if h["kind"] != WHOLE]
                if not hits:
                    continue
                words, edges = word_hashes(raw, bounds, spans)
                row = np.array([i for i, _ in hits])
                anchor, first, n, kind, crowded = (
                    np.array([h[k] for _, h in hits]) for k in ("anchor", "first", "n", "kind", "crowded")
                )
                at = first + edges[row]
                segment = spans.of(words, at, at + n + window - 1).view(np.int64)
                same = np.where(kind == BOTH, 0, np.arange(1, len(row) + 1))
                _, once = np.unique(np.stack([row, anchor, segment, n, same]), axis=1, return_index=True)
                row, anchor, first, n, kind, crowded, at = (x[once] for x in (row, anchor, first, n, kind, crowded, at))
                size = np.where(crowded, n, 1)
                part = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row, anchor, first, at, n, kind, crowded = (
                    np.repeat(x, size) for x in (row, anchor, first, at, n, kind, crowded)
                )
                at, first = at + part, first + part
                length = np.where(crowded, 0, n + window - 1)
                ends = np.concatenate([[0], np.cumsum(length)])
                flat = words[np.repeat(at - ends[:-1], length) + np.arange(ends[-1])].view(np.int64)
                hashes = mix64(spans.of(words, at, at + window)).view(np.int64)
                owner = pa.array(row)
                found = {
                    "rid": rows.column("rid").take(owner),
                    "rhash": rows.column("rhash").take(owner),
                    "anchor": pa.array(anchor, pa.int64()),
                    "first": pa.array(first.astype(np.int32)),
                    "single": pa.array(kind == SINGLE),
                    "hash": pa.array(hashes, mask=~crowded),
                    "words": lists(flat, ends),
                }
                found = pa.record_batch(found)
                for start, stop in cuts(length + 1, SLICE):
                    yield found.slice(start, stop - start)

    return run


def _shards(window: int):
    """Windows of single segments that another place holds: (rid, rhash, start).

    Rows come sorted by anchor; whole anchors are gathered to a shard of some SHARD words.
    """

    def looked(part: list) -> tuple[list, list, list]:
        automaton = Automaton(words for *_, words in part)
        owners, starts = [], []
        for rid, rhash, first, single, words in part:
            if single:
                ends = automaton.repeated_ends(words, window)
                owners += [(rid, rhash)] * len(ends)
                starts += [first + end - window for end in ends]
        return [r for r, _ in owners], [h for _, h in owners], starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part, size, last = None, [], 0, None

        def done():
            rid, rhash, starts = looked(part)
            return pa.record_batch(
                {"rid": pa.array(rid, kind), "rhash": pa.array(rhash, pa.int64()), "start": pa.array(starts, pa.int32())}
            )

        for batch in batches:
            kind = batch.schema.field("rid").type
            columns = (batch.column(c).to_pylist() for c in ("anchor", "rid", "rhash", "first", "single", "words"))
            for anchor, *row in zip(*columns):
                if anchor != last and size >= SHARD:
                    yield done()
                    part, size = [], 0
                last = anchor
                part.append(row)
                size += len(row[-1])
        if part:
            yield done()

    return run


def _kept(window: int):
    """The text that is left of each row, and its counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            left, counts, removed = [], [], []
            for text, hits, starts in zip(texts, batch.column("hits").to_pylist(), batch.column("starts").to_pylist()):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for hit in hits or ():
                    if hit["kind"] != SINGLE:
                        change[hit["first"]] += 1
                        change[hit["first"] + hit["n"] + window - 1] -= 1
                for start in starts or ():
                    change[start] += 1
                    change[start + window] -= 1
                covered = np.cumsum(change)[:-1] > 0
                counts.append(len(words))
                removed.append(int(covered.sum()))
                if removed[-1]:
                    words = [w for w, gone in zip(words, covered.tolist()) if not gone]
                left.append(b" ".join(words).decode())
            rows = batch.select(["row"])
            rows = rows.append_column("kept", pa.array(left)).append_column("n_words", pa.array(counts, pa.int64()))
            yield rows.append_column("n_removed", pa.array(removed, pa.int64()))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), *row_key(), whole_text().alias("text"))


def places(docs: DataFrame, window: int = WINDOW, spans: SpanHashes | None = None) -> DataFrame:
    """(rid, rhash, hits): the segments of each text whose anchors repeat, and how each is dealt with.

    Repeated rows share one entry, as long as that of a single row.
    """
    spans = spans or SpanHashes()
    plain = _keyed(docs).select("rid", "rhash", F.xxhash64("rid", "rhash").alias("rk"), "text")
    kind = plain.schema["rid"].dataType.simpleString()

    counted = plain.select("rk", "text").mapInArrow(_scan(window, spans, False), "anchor long, segment long, rk long")
    counted = counted.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min("rk").alias("head"))
    counted = materialise(counted, "segments")
    anchors = counted.groupBy("anchor").agg(
        F.sum("n").alias("total"),
        F.max(F.col("n") == 1).alias("singles"),
        (F.count("*") > CROWDED).alias("crowded"),
    )
    anchors = materialise(anchors.filter("total > 1"), "anchors")
    how = F.when(F.col("n") == 1, SINGLE).when(F.col("singles"), BOTH).otherwise(WHOLE)
    repeated = counted.join(anchors, "anchor").select("anchor", "segment", how.alias("kind"), "head", "crowded")
    repeated = materialise(repeated, "repeated")

    placed = plain.mapInArrow(
        _scan(window, spans, True), f"anchor long, segment long, rid {kind}, rhash long, rk long, first int, n int"
    )
    hits = placed.join(repeated, ["anchor", "segment"])
    kind_here = F.when((F.col("kind") == BOTH) & (F.col("rk") != F.col("head")), WHOLE).otherwise(F.col("kind"))
    hits = hits.withColumn("kind", kind_here).groupBy("rid", "rhash").agg(
        F.collect_set(F.struct("anchor", "first", "n", "kind", "crowded")).alias("hits")
    )
    return materialise(hits, "hits")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, kept, n_words, n_removed) of every row: what is left of the text, joined by spaces.

    A word goes if a window of ``window`` words that covers it has the same words as a window
    that starts anywhere else, in the same text too. Windows are judged on the input. Words
    are runs of anything but space and the controls 9 to 13; texts of fewer than ``window``
    words, empty and null ones lose nothing. Of repeated rows every one loses its windows.

    Texts are read for counting and for placing the segments, then dealt out by row key to be
    looked at with the segments found in them. Anchors, segments and windows of which there are
    very many meet only in sums that combine before the shuffle and on the many side of joins
    against one row per key; a shard holds CROWDED segments of an anchor at most.
    """
    spark = small_batches(docs.sparkSession)
    spans = SpanHashes()
    whole = _keyed(docs)
    kind = whole.schema["rid"].dataType.simpleString()
    hits = places(docs, window, spans).withColumnsRenamed({"rid": "hid", "rhash": "hhash"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.repartition(n, "rhash")
    here = (F.col("rhash") == F.col("hhash")) & F.col("rid").eqNullSafe(F.col("hid"))
    looked = dealt.join(hits, here).filter(F.exists("hits", lambda h: h["kind"] != WHOLE))
    apart = looked.select("rid", "rhash", "text", "hits").mapInArrow(
        _apart(window, spans),
        f"rid {kind}, rhash long, anchor long, first int, single boolean, hash long, words array<long>",
    )
    apart = materialise(apart, "apart")
    shards = apart.filter("hash is null").repartition(n, "anchor").sortWithinPartitions("anchor")
    shards = shards.mapInArrow(_shards(window), f"rid {kind}, rhash long, start int")
    windows = apart.filter("hash is not null").select("rid", "rhash", "anchor", "hash", "single", F.col("first").alias("start"))
    again = windows.groupBy("anchor", "hash").agg(F.count("*").alias("times")).filter("times > 1")
    again = materialise(again, "windows-again")
    windows = windows.filter("single").join(again, ["anchor", "hash"]).select("rid", "rhash", "start")
    starts = shards.unionByName(windows).groupBy(F.col("rid").alias("sid"), F.col("rhash").alias("shash")).agg(
        F.collect_set("start").alias("starts")
    )
    there = (F.col("rhash") == F.col("shash")) & F.col("rid").eqNullSafe(F.col("sid"))
    rows = dealt.join(hits, here, "left").join(starts, there, "left").select("row", "text", "hits", "starts")
    row = whole.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_kept(window), f"row {row}, kept string, n_words long, n_removed long")


DEDUP_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win
  WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""


@query(DEDUP_SQL)
def op7_substring_dedup(spark, sf_dir):
    """Words that every document of ``documents`` loses to repeated windows, and what is left."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
