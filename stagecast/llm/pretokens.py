"""Cutting texts into pre-tokens with numpy and encoding each distinct one once.

The pattern of the byte-level vocabularies cuts a text at changes between letters, numbers,
white space and the rest, gives one space to the run after it and splits English
contractions off. That is worked out here on arrays of code points for many rows at once.
"""

from __future__ import annotations

import numpy as np
import regex

from stagecast.llm.common import SpanHashes

OTHER, LETTER, NUMBER, SPACE = range(4)
TOP = 0x110000
#: Distinct pre-tokens, and their characters, kept per Python worker; beyond, the memory starts afresh.
KEPT, KEPT_POINTS = 1_000_000, 1 << 24


def pattern_classes() -> np.ndarray:
    r"""The class of each code point as the pattern's \p{L}, \p{N} and \s see it."""
    table = np.zeros(TOP, dtype=np.uint8)
    valid = np.r_[0:0xD800, 0xE000:TOP].astype(np.uint32)
    line = valid.tobytes().decode("utf-32-le")
    for kind, text in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(text, line):
            table[valid[run.start() : run.end()]] = kind
    return table


def library_classes(tokenizer) -> np.ndarray:
    """The class of each code point, asked of a tokenizer's own byte-level pre-tokenizer.

    All code points in order are cut into stretches of one class (a space belongs to the
    stretch after it). A stretch is of letters if its end joins a letter before it, and so
    on; what joins nothing is white space.
    """
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str
    valid = np.r_[0:0xD800, 0xE000:TOP].astype(np.uint32)
    spans = [span for _, span in pieces(valid.tobytes().decode("utf-32-le"))]
    table = np.full(TOP, SPACE, dtype=np.uint8)
    for start, stop in spans:
        for kind, mark in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")):
            if len(pieces(mark + chr(valid[stop - 1]))) == 1:
                table[valid[start:stop]] = kind
    table[32] = SPACE
    return table


def cut(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each code point begins a pre-token; ``first`` marks the first of each row."""
    n = len(points)
    begins = first.copy()
    if not n:
        return begins
    begins[1:] |= kinds[1:] != kinds[:-1]
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~first[1:]
    heads = np.nonzero(after_space)[0]
    begins[heads - 1] = True
    begins[heads[points[heads - 1] == 32]] = False

    quote = np.nonzero((points == 39) & begins)[0]
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        pair = np.append(~first, [False, False])[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = pair & np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        quote, size = quote[short | long], np.where(short, 1, 2)[short | long]
        begins[quote + 1] = False
        rest = quote + 1 + size
        inside = rest < n
        rest = rest[inside]
        begins[rest[(kinds[rest] == LETTER) & ~first[rest]]] = True
    return begins


def gather(spans: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The pool's stretches ``spans`` (by number) one after another."""
    size = lengths[spans]
    total = int(size.sum())
    shift = starts[spans] - (np.cumsum(size) - size)
    return pool[np.repeat(shift, size) + np.arange(total)]


class Encoder:
    """Ids of whole rows. ``encode`` turns a list of distinct pre-tokens into lists of ids.

    Pre-tokens are found by a hash of their code points and compared with the stored one; one
    that shares its hash with another is encoded apart, so a collision costs time only.
    """

    def __init__(self, classes: np.ndarray, encode):
        self.classes, self.encode = classes, encode
        self.hashes = SpanHashes()
        self.kept = None  # fewer pre-tokens than KEPT, where several encoders share a worker
        self.forget()

    def begins(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each code point begins a pre-token; ``first`` marks the first of each row."""
        return cut(points, self.classes[points], first)

    def forget(self):
        self.known = np.zeros(0, dtype=np.uint64)
        self.number = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.places = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.points = np.zeros(0, dtype=np.uint32)

    def rows(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array and the rows' boundaries in it."""
        starts, spans, edges = self.pieces(raw, bounds)
        ids = gather(spans, self.starts, self.lengths, self.ids)
        ends = np.concatenate([[0], np.cumsum(self.lengths[spans])])
        return ids, ends[np.searchsorted(starts, edges)]

    def counts(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the pre-tokens of all rows begin, their numbers of ids, the rows' bounds; in characters."""
        starts, spans, edges = self.pieces(raw, bounds)
        return starts, self.lengths[spans], edges

    def pieces(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and numbers of all rows' pre-tokens, and the rows' bounds in characters."""
        if not len(raw):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(bounds), dtype=np.int64)
        text = raw.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if len(points) == len(raw):
            edges = bounds
        else:
            edges = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
        first = np.zeros(len(points), dtype=bool)
        first[edges[:-1][edges[:-1] < len(points)]] = True
        starts = np.nonzero(self.begins(points, first))[0]
        stops = np.append(starts[1:], len(points))
        if len(self.starts) > (self.kept or KEPT) or len(self.points) > KEPT_POINTS:
            self.forget()
        distinct, at, back = np.unique(self.hashes.of(points, starts, stops), return_index=True, return_inverse=True)
        numbers = self._numbers(distinct, text, starts[at], stops[at])[back]
        odd = self._unlike(points, numbers, starts, stops)
        if len(odd):
            texts = [text[a:b] for a, b in zip(starts[odd].tolist(), stops[odd].tolist())]
            own = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            numbers[odd] = self._store(list(own))[[own[t] for t in texts]]
        return starts, numbers, edges

    def _unlike(self, points, numbers, starts, stops) -> np.ndarray:
        """Pre-tokens whose code points differ from those stored under their number."""
        sizes = stops - starts
        unlike = self.sizes[numbers] != sizes
        shift = np.where(unlike, 0, self.places[numbers] - starts)
        place = np.arange(len(points)) + np.repeat(shift, sizes)
        place[np.repeat(unlike, sizes)] = 0
        differs = self.points[place] != points
        if differs.any():
            unlike |= np.logical_or.reduceat(differs, starts)
        return np.nonzero(unlike)[0]

    def _store(self, texts: list[str]) -> np.ndarray:
        """New numbers of pre-tokens, with their ids and code points."""
        found = self.encode(texts)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(lengths.sum()))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        numbers = len(self.starts) + np.arange(len(texts))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, flat)
        self.places = np.append(self.places, len(self.points) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.points = np.append(self.points, np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32))
        return numbers

    def _numbers(self, hashes, text, starts, stops) -> np.ndarray:
        place = np.searchsorted(self.known, hashes)
        seen = np.zeros(len(hashes), dtype=bool)
        inside = place < len(self.known)
        seen[inside] = self.known[place[inside]] == hashes[inside]
        new = np.nonzero(~seen)[0]
        if len(new):
            numbers = self._store([text[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist())])
            self.known = np.insert(self.known, place[new], hashes[new])
            self.number = np.insert(self.number, place[new], numbers)
            place = np.searchsorted(self.known, hashes)
        return self.number[place]
