"""Document fingerprints from prefix polynomial hashes.

For a text c[0], c[1], ... the prefix array holds the sums of c[j] * B**j modulo a prime. The
hash of any span is a difference of two entries, brought to position 0 with a power of B's
inverse, so spans of any two texts can be compared in constant time and the longest common
extension of two places follows by binary search. Two primes of 31 bits are used together.

A fingerprint holds the hash of the whole text, its length, and a sketch: the spans of SPAN
characters are dealt to BINS bins by their mixed hash, and the smallest of each bin is kept.
The share of bins in which two sketches agree estimates the overlap of the texts' spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.blocks import in_blocks
from stagecast.llm.common import cuts, mix64, query, small_batches, table, whole_text

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_347_823_043, 1_690_451_171)
SPAN, BINS = 8, 128
EMPTY = 0xFFFF
#: Characters worked on at once; a longer document is a piece of its own.
SLICE = 1 << 19


class Prefixes:
    """Powers of the bases and their inverses, shared by all texts of a worker."""

    def __init__(self):
        self.powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in PRIMES]

    def upto(self, n: int):
        for k, (prime, base) in enumerate(zip(PRIMES, BASES)):
            for way, b in enumerate((base, pow(base, -1, prime))):
                have = self.powers[k][way]
                while len(have) <= n:
                    step = np.uint64(pow(b, len(have), prime))
                    have = np.concatenate([have, have * step % np.uint64(prime)])
                self.powers[k][way] = have
        return self.powers

    def arrays(self, points: np.ndarray) -> list[np.ndarray]:
        """Prefix sums for each prime; they stay below 2**64 for 2**32 characters."""
        out = []
        for (up, _), prime in zip(self.upto(len(points)), PRIMES):
            sums = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum((points + np.uint64(1)) * up[: len(points)] % np.uint64(prime), out=sums[1:])
            out.append(sums)
        return out

    def spans(self, arrays: list[np.ndarray], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """One 62-bit hash of each span [start, stop), equal for equal spans of any texts."""
        parts = []
        for sums, (_, down), prime in zip(arrays, self.powers, PRIMES):
            p = np.uint64(prime)
            parts.append((sums[stops] - sums[starts]) % p * down[starts] % p)
        return parts[0] << np.uint64(31) | parts[1]

    def common_extension(self, one, at_one: np.ndarray, other, at_other: np.ndarray, most=None, back: bool = False) -> np.ndarray:
        """Length of the longest common span that begins (with ``back``: ends) at each pair of places.

        ``one`` and ``other`` are prefix arrays; all pairs are searched at the same time, each up
        to ``most`` characters, by default to the end of the arrays.
        """
        if most is None:
            most = np.minimum(at_one, at_other) if back else np.minimum(len(one[0]) - 1 - at_one, len(other[0]) - 1 - at_other)
        low, high = np.zeros(len(at_one), dtype=np.int64), np.array(most, dtype=np.int64)
        while np.any(low < high):
            middle = (low + high + 1) // 2
            ahead, behind = (0, middle) if back else (middle, 0)
            own = self.spans(one, at_one - behind, at_one + ahead)
            same = own == self.spans(other, at_other - behind, at_other + ahead)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


PREFIXES = Prefixes()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the texts' bounds in them."""
    bounds = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), bounds


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-text hashes, lengths and sketches (one row of BINS values, EMPTY where none).

    A text shorter than SPAN characters has one span, itself; an empty one has none.
    """
    points, bounds = code_points(texts)
    arrays = PREFIXES.arrays(points)
    lengths = np.diff(bounds)
    whole = PREFIXES.spans(arrays, bounds[:-1], bounds[1:])
    counts = np.where(lengths == 0, 0, np.maximum(lengths - SPAN + 1, 1))
    doc = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][doc]
    hashes = mix64(PREFIXES.spans(arrays, starts, np.minimum(starts + SPAN, bounds[1:][doc])))
    bins = (hashes >> np.uint64(57)).astype(np.int64) * BINS >> 7
    low = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(low, doc * BINS + bins, hashes & np.uint64((1 << 57) - 1))
    values = (low % np.uint64(EMPTY)).astype(np.uint16)
    values[low == np.iinfo(np.uint64).max] = EMPTY
    return whole, lengths, values.reshape(-1, BINS)


def likeness(one, other) -> np.ndarray:
    """Likeness of fingerprints row by row: 1 for equal texts, else the estimated share of common spans.

    With J the share of bins that agree among those filled in either, 2J / (1 + J) is the
    share of common spans in the mean number of spans of both texts.
    """
    filled = (one[2] != EMPTY) | (other[2] != EMPTY)
    agree = ((one[2] == other[2]) & filled).sum(axis=1)
    jaccard = agree / np.maximum(filled.sum(axis=1), 1)
    same = (one[0] == other[0]) & (one[1] == other[1])
    return np.where(same, 1.0, 2 * jaccard / (1 + jaccard))


def written(found) -> list[str]:
    """Fingerprints as text: hash (16 digits), length (8), then four digits for each bin."""
    return [f"{int(h):016x}{int(n):08x}{s.astype('>u2').tobytes().hex()}" for h, n, s in zip(*found)]


def read(fingerprints: list[str]):
    """The reverse of ``written``."""
    tail = np.frombuffer(bytes.fromhex("".join(f[24:] for f in fingerprints)), dtype=">u2").astype(np.uint16)
    return (
        np.array([int(f[:16], 16) for f in fingerprints], dtype=np.uint64),
        np.array([int(f[16:24], 16) for f in fingerprints]),
        tail.reshape(-1, BINS),
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """(row, fingerprint) for every row; null texts count as empty, equal texts get equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in cuts(np.array([len(t) for t in texts]), SLICE):
                rows = batch.slice(a, b - a).drop_columns(["text"])
                yield rows.append_column("fingerprint", pa.array(written(sketches(texts[a:b]))))

    whole = docs.select(F.struct("*").alias("row"), whole_text().alias("text"))
    kind = whole.schema["row"].dataType.simpleString()
    return whole.mapInArrow(run, f"row {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def common_ends(texts: list[str], pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the longest common beginning and end of pairs of texts, given by their places."""
    points, bounds = code_points(texts)
    arrays = PREFIXES.arrays(points)
    most = np.minimum(*(bounds[p + 1] - bounds[p] for p in pairs))
    starts, stops = ([bounds[p + k] for p in pairs] for k in (0, 1))
    first = PREFIXES.common_extension(arrays, starts[0], arrays, starts[1], most)
    return first, PREFIXES.common_extension(arrays, stops[0], arrays, stops[1], most, back=True)


EDITS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "prefix_edited long, suffix_edited long, prefix_next long, suffix_next long"
)


def _compare(idents: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all texts but the last, each followed by the next one."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, new = sketches(texts), sketches(changed)
    n = len(changed)
    before, after = tuple(x[:n] for x in own), tuple(x[1:] for x in own)
    at = np.arange(n)
    first, last = common_ends([*texts, *changed], (np.tile(at, 2), np.concatenate([at + len(texts), at + 1])))
    return pa.record_batch(
        {
            "doc_id": pa.array(idents[:n]),
            "n_chars": pa.array(own[1][:n], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            "fingerprint": pa.array(written(before)),
            "edited_fingerprint": pa.array(written(new)),
            "near_edited": pa.array(likeness(before, new)),
            "near_next": pa.array(likeness(before, after)),
            "prefix_edited": pa.array(first[:n]),
            "suffix_edited": pa.array(last[:n]),
            "prefix_next": pa.array(first[n:]),
            "suffix_next": pa.array(last[n:]),
        }
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, in order, each block closed by a copy of the first row of the next."""
    block, idents, texts, size, head, closed = None, [], [], 0, None, True
    kind = None

    def flush():
        found = _compare(idents, texts)
        return found.set_column(0, "doc_id", found.column(0).cast(kind))

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        rows = zip(*(batch.column(c).to_pylist() for c in ("block", "copy", "doc_id", "text")))
        for b, copy, ident, text in rows:
            if b != block:
                if not closed:  # a table without ids is one block: its first row follows its last
                    idents, texts = [*idents, None], [*texts, head]
                    yield flush()
                block, idents, texts, size, head, closed = b, [], [], 0, text, False
            if closed:
                continue  # further copies of a repeated id
            idents.append(ident)
            texts.append(text)
            size += len(text)
            if copy or size > SLICE and len(texts) > 1:
                yield flush()
                idents, texts, size, closed = idents[-1:], texts[-1:], len(text), bool(copy)
    if not closed:
        idents, texts = [*idents, None], [*texts, head]
        yield flush()


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's beginning.

    The next document is the one that follows in descending order of doc_id (a whole number;
    null last, equal ids by text hash); the first follows the last. The first row of a block
    of ids is copied to the block before it, so the texts cross one shuffle and no window
    runs over all rows.
    Null texts are empty; a lone row follows itself; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = in_blocks(rows, "doc_id", descending=True, heads=True)
    rows = rows.sortWithinPartitions("block", "copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.select("block", "copy", "doc_id", "text").mapInArrow(_stream, f"doc_id {kind}, {EDITS}")


@query()
def op3_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document of ``documents`` and of its edited text, and their likeness."""
    return edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
