"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of two half-chunks, each overlapping the next by one, so
that the chunks cover the whole text. Learned filters over WIDTH bytes run over every byte
(as sums of one table row per byte, which is what a convolution of one-hot bytes amounts to),
their rectified responses are averaged and maximised per chunk, a hidden layer describes the
chunk, and the maximum and mean over all chunks are combined into one probability.

Training runs on the driver over a bounded sample of labelled documents (MOST_PER_CLASS) and of
runs drawn from the whole of each text (MOST_RUNS, MOST_CHUNKS). The cut is set on whole texts,
and scoring covers every byte of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import query, small_batches, table, text_slices, whole_text
from stagecast.session import materialise

HALF, WIDTH, FILTERS, HIDDEN = 128, 4, 16, 24
PAD = 256
#: Bounds of the training sample: documents of each class, runs taken of each to the driver,
#: half-chunks in a run.
MOST_PER_CLASS, MOST_RUNS, MOST_CHUNKS = 1200, 8, 24
EPOCHS, BATCH, RATE = 11, 64, 0.01
THRESHOLD = 0.7
#: How much more it counts to lose a good text than to keep a poor one when the cut is set.
KEEP = 4.0
#: Shares of the good texts learned from in part, and of all texts that set the cut.
SHORT, CUT_ON = 0.5, 0.25
SLICE = 1 << 19


def half_chunks(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of HALF + WIDTH - 1 symbols, each reaching into the next, and the texts' bounds in them.

    A text has two half-chunks at least, the last ones filled with PAD; an empty one is all PAD.
    """
    sizes = np.diff(bounds)
    counts = np.maximum(2, -(-sizes // HALF))
    ends = np.concatenate([[0], np.cumsum(counts)])
    symbols = np.full((ends[-1], HALF + WIDTH - 1), PAD, dtype=np.int16)
    flat = np.full(ends[-1] * HALF, PAD, dtype=np.int16)
    flat[np.arange(len(raw)) + np.repeat(ends[:-1] * HALF - bounds[:-1], sizes)] = raw
    symbols[:, :HALF] = flat.reshape(-1, HALF)
    symbols[:-1, HALF:] = symbols[1:, : WIDTH - 1]
    symbols[ends[1:] - 1, HALF:] = PAD
    return symbols, ends


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda *shape, fan: draw.normal(0, fan**-0.5, shape).astype(np.float32)
        self.p = {
            "tables": scale(WIDTH, PAD + 1, FILTERS, fan=WIDTH),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": scale(2 * FILTERS, HIDDEN, fan=2 * FILTERS),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": scale(2 * HIDDEN, fan=2 * HIDDEN),
            "b2": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def responses(self, symbols: np.ndarray) -> np.ndarray:
        """Rectified filter responses, (half-chunks, HALF, FILTERS)."""
        total = self.p["tables"][0][symbols[:, :HALF]]
        for j in range(1, WIDTH):
            total += self.p["tables"][j][symbols[:, j : j + HALF]]
        total += self.p["bias"]
        return np.maximum(total, 0, out=total)

    def forward(self, symbols: np.ndarray, ends: np.ndarray, keep: bool = False):
        r = self.responses(symbols)
        mean, top = r.mean(axis=1), r.max(axis=1)
        # a chunk is a half-chunk and the next one of the same text
        last = np.zeros(len(symbols), dtype=bool)
        last[ends[1:] - 1] = True
        first = np.nonzero(~last)[0]
        cmean, ctop = (mean[first] + mean[first + 1]) / 2, np.maximum(top[first], top[first + 1])
        pooled = np.concatenate([cmean, ctop], axis=1)
        hidden = np.maximum(pooled @ self.p["w1"] + self.p["b1"], 0)
        starts = ends[:-1] - np.arange(len(ends) - 1)
        counts = np.diff(ends) - 1
        doc_top = np.maximum.reduceat(hidden, starts, axis=0)
        doc_mean = np.add.reduceat(hidden, starts, axis=0) / counts[:, None]
        both = np.concatenate([doc_top, doc_mean], axis=1)
        logit = both @ self.p["w2"] + self.p["b2"][0]
        return (logit, (r, top, first, ctop, pooled, hidden, counts, doc_top, both)) if keep else logit

    def scores(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        logit = self.forward(symbols, ends).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def gradient(self, symbols, ends, good, weight) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy."""
        logit, (r, top, first, ctop, pooled, hidden, counts, doc_top, both) = self.forward(symbols, ends, True)
        slope = ((1 / (1 + np.exp(-logit)) - good) * weight / len(good)).astype(np.float32)
        g = {"w2": both.T @ slope, "b2": np.array([slope.sum()], np.float32)}
        d_both = slope[:, None] * self.p["w2"]
        doc = np.repeat(np.arange(len(counts)), counts)
        at_top = hidden == doc_top[doc]
        share = np.add.reduceat(at_top.astype(np.float32), ends[:-1] - np.arange(len(counts)), axis=0)
        d_hidden = at_top * (d_both[:, :HIDDEN] / share)[doc] + (d_both[:, HIDDEN:] / counts[:, None])[doc]
        d_hidden *= hidden > 0
        g["w1"], g["b1"] = pooled.T @ d_hidden, d_hidden.sum(axis=0)
        d_pooled = d_hidden @ self.p["w1"].T
        d_mean, d_top = np.zeros_like(top), np.zeros_like(top)
        half = d_pooled[:, :FILTERS] / (2 * HALF)
        d_mean[first] += half
        d_mean[first + 1] += half
        left = top[first] >= ctop
        d_top[first] += d_pooled[:, FILTERS:] * left
        d_top[first + 1] += d_pooled[:, FILTERS:] * ~left
        d_r = np.broadcast_to(d_mean[:, None], r.shape).copy()
        np.put_along_axis(
            d_r, r.argmax(axis=1)[:, None], np.take_along_axis(d_r, r.argmax(axis=1)[:, None], 1) + d_top[:, None], 1
        )
        d_r *= r > 0
        flat = d_r.reshape(-1, FILTERS)
        g["bias"], g["tables"] = flat.sum(axis=0), np.empty_like(self.p["tables"])
        for j in range(WIDTH):
            seen = symbols[:, j : j + HALF].reshape(-1)
            for f in range(FILTERS):
                g["tables"][j, :, f] = np.bincount(seen, weights=flat[:, f], minlength=PAD + 1)
        return g


def _runs(text: bytes, draw: np.random.Generator) -> list[bytes]:
    """A text as one run if MOST_RUNS runs hold it, else a run from each of MOST_RUNS equal parts."""
    most = MOST_CHUNKS * HALF
    if len(text) <= MOST_RUNS * most:
        return [text]
    edges = [len(text) * i // MOST_RUNS for i in range(MOST_RUNS + 1)]
    places = [int(draw.integers(low, high - most + 1)) for low, high in pairwise(edges)]
    return [text[at : at + most] for at in places]


def excerpts(text: bytes, good: int, seed: int = 7) -> tuple[bool, list[bytes], list[bytes]]:
    """Whether a text is left out of the fit, the runs to learn from, and those of a few words.

    Part of a good text is as good, so SHORT of the good texts give a few words as well. The draw
    depends on the text and the seed alone, so a task and the driver draw the same.
    """
    draw = np.random.default_rng([seed, zlib.crc32(text)])
    apart, few = bool(draw.random() < CUT_ON), []
    if good and draw.random() < SHORT:
        words = text.split()
        at = int(draw.integers(0, max(1, len(words))))
        few = _runs(b" ".join(words[at : at + int(draw.integers(1, 30))]), draw)
    return apart, _runs(text, draw), few


def _symbols(runs: list[bytes]) -> np.ndarray:
    return np.concatenate([half_chunks(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in runs])


def _logits(net: Network, texts: list[bytes]) -> np.ndarray:
    found = [net.forward(*half_chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in texts]
    return np.array(found, dtype=np.float64)


def train(texts: list[bytes], good: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to whole texts and labels (1 good, 0 poor)."""
    drawn = [excerpts(t, int(y), seed) for t, y in zip(texts, good)]
    return fit(drawn, good, lambda net, left: _logits(net, [texts[i] for i in left]), seed)


def fit(
    drawn: list[tuple[bool, list[bytes], list[bytes]]],
    good: np.ndarray,
    whole: Callable[[Network, list[int]], np.ndarray],
    seed: int = 7,
) -> Network:
    """A network fitted to the excerpts of texts; Adam over a fixed number of epochs.

    The classes weigh the same. The texts left out of the fit set ``shift``, so that THRESHOLD
    falls where they are divided with the least error, a good text below counting KEEP times;
    ``whole`` gives their logits, over whole texts, from the network and their places. With
    labels of one class only the network leans to that class.
    """
    net, draw = Network(seed), np.random.default_rng(seed)
    offset = np.log(THRESHOLD / (1 - THRESHOLD))
    if len(set(good.tolist())) < 2:
        net.p["w2"][:] = 0
        net.shift = offset + (2.0 if len(good) == 0 or good[0] else -2.0)
        return net
    few = [i for i, (_, _, words) in enumerate(drawn) if words]
    pieces = [_symbols(runs) for _, runs, _ in drawn] + [_symbols(drawn[i][2]) for i in few]
    source = np.concatenate([np.arange(len(drawn)), np.array(few, dtype=int)])
    labels = np.asarray(good, dtype=int)[source]
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    apart = np.array([left for left, _, _ in drawn])[source]
    if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
        apart[:] = True  # too few texts to leave some out
        learn = np.arange(len(pieces))
    else:
        learn = np.nonzero(~apart)[0]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, steps = 0, EPOCHS * -(-len(learn) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(learn)
        for i in range(0, len(order), BATCH):
            g = _batch_gradient(net, pieces, order[i : i + BATCH], labels, weights)
            step += 1
            rate = RATE * (1 - step / steps) + 1e-4
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    left = np.nonzero(apart)[0]
    texts, words = left[left < len(drawn)], left[left >= len(drawn)]
    short = [net.forward(pieces[i], np.array([0, len(pieces[i])]))[0] for i in words]
    logit = np.concatenate([whole(net, texts.tolist()), np.array(short, dtype=np.float64)])
    net.shift = float(offset - _cut(logit, labels[left], weights[left]))
    return net


def _batch_gradient(net: Network, pieces: list[np.ndarray], some: np.ndarray, labels, weights) -> dict[str, np.ndarray]:
    """The gradient of a batch, summed over parts that hold BATCH runs of half-chunks at most."""
    total: dict[str, np.ndarray] = {}
    place = np.cumsum([len(pieces[k]) for k in some]) // (BATCH * MOST_CHUNKS)
    for part in np.split(some, np.nonzero(np.diff(place))[0] + 1):
        ends = np.concatenate([[0], np.cumsum([len(pieces[k]) for k in part])])
        g = net.gradient(np.concatenate([pieces[k] for k in part]), ends, labels[part], weights[part])
        for k, v in g.items():
            total[k] = total.get(k, 0) + v * np.float32(len(part) / len(some))
    return total


def _cut(logit: np.ndarray, good: np.ndarray, weights: np.ndarray) -> float:
    """The logit that divides good from poor with the least weighted error.

    Of equally good cuts it takes one nearer to the poor texts, in the ratio of KEEP to 1.
    """
    order = np.argsort(logit)
    x, w = logit[order], weights[order] * np.where(good[order] == 1, KEEP, -1)
    error = np.concatenate([[0], np.cumsum(w)])  # good ones below the cut, less poor ones
    edges = (x[0] - 1, x[-1] + 1)
    best = np.nonzero(error <= error.min() + 1e-9)[0]
    low, high = (x[best[0] - 1] if best[0] else edges[0]), (x[best[-1]] if best[-1] < len(x) else edges[-1])
    return float(low + (high - low) / (1 + KEEP))


def held_out(ident):
    """Whether a document's labels are kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def chosen(docs: DataFrame, labels: DataFrame, per_class: int = MOST_PER_CLASS) -> DataFrame:
    """(doc_id, text, q) to learn from: up to ``per_class`` documents of each class.

    They are the labelled rows of ``docs`` with the smallest hash of the id, those held out left
    out. An id with labels that differ, or a null label, teaches nothing.
    """
    known = labels.filter("doc_id is not null and quality is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_id"))
    known = known.agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2")
    there = docs.select(F.col("doc_id").alias("label_id")).distinct()
    known = known.join(there, "label_id", "left_semi")  # ids that docs lacks take no place
    best = [known.filter(F.col("q") == q).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class) for q in (0, 1)]
    best = F.broadcast(best[0].unionByName(best[1]))
    texts = docs.select("doc_id", whole_text().alias("text")).join(best, F.col("doc_id") == F.col("label_id"))
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "q")).alias("r"))
    return texts.select("doc_id", "r.text", F.col("r.q").cast("int").alias("q"))


def _drawn(rows: DataFrame) -> list:
    """(doc_id, q, apart, runs, few) of chosen texts, by id; the tasks draw from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("q").to_pylist())
            apart, runs, few = map(list, zip(*[excerpts(t.encode(), q) for t, q in pairs])) if len(batch) else ([], [], [])
            out = batch.drop_columns(["text"]).append_column("apart", pa.array(apart, pa.bool_()))
            for name, found in (("runs", runs), ("few", few)):
                out = out.append_column(name, pa.array(found, pa.list_(pa.binary())))
            yield out

    kind = rows.schema["doc_id"].dataType.simpleString()
    small_batches(rows.sparkSession)
    found = rows.select("doc_id", "text", "q").mapInArrow(
        run, f"doc_id {kind}, q int, apart boolean, runs array<binary>, few array<binary>"
    )
    return found.orderBy("doc_id").collect()


def _excerpts_of(found: list) -> tuple[list[tuple[bool, list[bytes], list[bytes]]], np.ndarray]:
    drawn = [(r["apart"], [bytes(x) for x in r["runs"]], [bytes(x) for x in r["few"]]) for r in found]
    return drawn, np.array([r["q"] for r in found], dtype=int)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = MOST_PER_CLASS):
    """Excerpts and labels of the chosen documents; only the runs are taken to the driver."""
    return _excerpts_of(_drawn(chosen(docs, labels, per_class)))


def whole_logits(rows: DataFrame, net: Network, ids: list) -> np.ndarray:
    """Logits, without shift, of the whole texts of ``ids``, in their order."""
    sent = rows.sparkSession.sparkContext.broadcast((net, set(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net, ids = sent.value
            batch = batch.filter(pa.array([i in ids for i in batch.column("doc_id").to_pylist()], pa.bool_()))
            for part, raw, bounds in text_slices(batch, "text", SLICE):
                logit = net.forward(*half_chunks(raw, bounds)).astype(np.float64)
                yield part.select(["doc_id"]).append_column("logit", pa.array(logit))

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = dict(rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, logit double").collect())
    return np.array([found[i] for i in ids], dtype=np.float64)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(row, score) for every row; ``row`` is a struct of all columns of ``docs``.

    The score is the probability of good quality. Null and empty texts get the score of an
    empty text; repeated rows get equal scores, as nothing but the text enters.
    """
    sent = small_batches(docs.sparkSession).sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                found = sent.value.scores(*half_chunks(raw, bounds))
                yield rows.drop_columns(["text"]).append_column("score", pa.array(found))

    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    rows = docs.select(F.struct("*").alias("row"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"row {kind}, score double")


def classifier(docs: DataFrame, labels: DataFrame) -> Network:
    rows = materialise(chosen(docs, labels), "labelled")
    found = _drawn(rows)
    return fit(*_excerpts_of(found), lambda net, left: whole_logits(rows, net, [found[i]["doc_id"] for i in left]))


@query()
def op9_quality_classifier(spark, sf_dir):
    """Quality score of every document of ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = classifier(docs, table(spark, sf_dir, "labels"))
    ident = F.col("row.doc_id")
    return score(docs.select("doc_id", "text"), net).select(
        ident.alias("doc_id"),
        held_out(ident).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
