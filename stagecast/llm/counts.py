"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: a leaf covers LEAF pre-tokens and holds
their characters and tokens, an inner node the sums of its two children. After an edit only
the leaves it touches are cut and encoded anew, from a leaf that ends before anything the cut
can look at to the first old leaf end that is a pre-token's end again; then the sums above
the changed leaves are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.bpe import SLICE, read_ranks, shared_encoder, tokenizer_json, vocabulary
from stagecast.llm.common import lists, query, small_batches, table, text_slices, whole_text
from stagecast.llm.pretokens import Encoder, pattern_classes

LEAF = 32
#: Characters after a pre-token that its end can depend on: a contraction's two letters, or the
#: last white space of a run and what follows.
AHEAD = 2


class Tree:
    """Sums of characters and tokens; node 1 is the root, i has the children 2i and 2i + 1."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.leaves = sums, len(sums) // 2

    @classmethod
    def of(cls, leaves: np.ndarray) -> "Tree":
        """A tree over rows (characters, tokens), filled up with empty leaves."""
        size = 1 << max(len(leaves) - 1, 0).bit_length()
        sums = np.zeros((2 * size, 2), dtype=np.int64)
        sums[size : size + len(leaves)] = leaves
        while size > 1:
            size //= 2
            sums[size : 2 * size] = sums[2 * size : 4 * size].reshape(-1, 2, 2).sum(axis=1)
        return cls(sums)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one beyond), and its first character."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            size = int(self.sums[node, 0])
            if place >= start + size and self.sums[node + 1, 0]:
                start, node = start + size, node + 1
        return node - self.leaves, start

    def put(self, first: int, last: int, leaves: np.ndarray) -> "Tree":
        """The tree with the leaves first .. last replaced; sums change only above them."""
        if len(leaves) > last - first + 1:
            at = self.sums[self.leaves :]
            full = np.concatenate([at[:first], leaves, at[last + 1 :]])
            return Tree.of(full[(full != 0).any(axis=1)])
        some = self.sums[self.leaves + first : self.leaves + last + 1]
        some[:] = 0
        some[: len(leaves)] = leaves
        low, high = (self.leaves + first) // 2, (self.leaves + last) // 2
        while low:
            nodes = np.arange(low, high + 1)
            self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
            low, high = low // 2, high // 2
        return self


def leaves_of(starts: np.ndarray, tokens: np.ndarray, chars: int) -> np.ndarray:
    """Leaves (characters, tokens) over pre-tokens that begin at ``starts``."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    heads = np.arange(0, len(starts), LEAF)
    return np.stack([np.diff(np.append(starts[heads], chars)), np.add.reduceat(tokens, heads)], axis=1)


def edit(tree: Tree, text: str, start: int, stop: int, new: str):
    """Replace text[start:stop] by ``new``; places outside the text mean its end.

    A generator: it yields regions to be cut and encoded, is sent the starts of their pre-tokens
    and their numbers of tokens, and returns the new tree and text and the characters encoded.
    """
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    after = text[:start] + new + text[stop:]
    shift = len(after) - len(text)
    first, begin = tree.find(max(start - AHEAD - 1, 0))
    # a leaf is safe if it ends AHEAD characters before the edit
    last, last_begin = tree.find(max(stop, begin))
    size = lambda leaf: int(tree.sums[tree.leaves + leaf, 0])
    end, work = last_begin + size(last), 0
    while True:
        # some characters of the next leaf show whether a pre-token ends with this one
        extra = min(len(text), end + AHEAD + 1) - end
        region = after[begin : end + shift + extra]
        starts, tokens = yield region
        work += len(region)
        cut = end + shift - begin
        at = int(np.searchsorted(starts, cut))
        if end == len(text) or at < len(starts) and starts[at] == cut:
            break
        last += 1
        while not size(last):
            last += 1
        end += size(last)
    if end == len(text):
        at = len(starts)
    return tree.put(first, last, leaves_of(starts[:at], tokens[:at], cut)), after, work


def _edits(tree: Tree, text: str, edits: list):
    """All edits of one document, as one generator like ``edit``."""
    work = 0
    for e in edits:
        tree, text, more = yield from edit(tree, text, e["start"], e["stop"], e["new"] or "")
        work += more
    return tree, text, work


def run_all(encoder: Encoder, jobs: list) -> list:
    """Run generators like ``edit`` side by side, so that the regions asked for are encoded together."""
    done: list = [None] * len(jobs)
    waiting, answers = list(range(len(jobs))), [None] * len(jobs)
    while waiting:
        asked, regions = [], []
        for i in waiting:
            try:
                regions.append(jobs[i].send(answers[i]).encode())
                asked.append(i)
            except StopIteration as end:
                done[i] = end.value
        if regions:
            bounds = np.cumsum([0, *map(len, regions)])
            starts, tokens, edges = encoder.counts(np.frombuffer(b"".join(regions), dtype=np.uint8), bounds)
            at = np.searchsorted(starts, edges)
            for i, a, b, edge in zip(asked, at, at[1:], edges):
                answers[i] = (starts[a:b] - edge, tokens[a:b])
        waiting = asked
    return done


def index(docs: DataFrame, path: str) -> DataFrame:
    """(row, tree) for every row; tree is the array of characters and tokens by node, in turn.

    Elements 2 and 3 are the root: the text's characters and tokens. Null texts count as
    empty; repeated rows have equal trees; an empty table gives an empty table.
    """
    spark = small_batches(docs.sparkSession)
    encoder = shared_encoder(spark, tokenizer_json(read_ranks(path)), pattern_classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                starts, tokens, edges = own.counts(raw, bounds)
                at = np.searchsorted(starts, edges)
                trees = [
                    Tree.of(leaves_of(starts[a:b], tokens[a:b], edge)).sums.reshape(-1)
                    for a, b, edge in zip(at, at[1:], edges[1:])
                ]
                ends = np.cumsum([0, *map(len, trees)])
                column = lists(np.concatenate(trees).astype(np.int32), ends)
                yield pa.record_batch({"row": rows.column("row"), "tree": column})

    whole = docs.select(F.struct("*").alias("row"), whole_text().alias("text"))
    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, tree array<int>")


def recount(rows: DataFrame, path: str) -> DataFrame:
    """Apply edits to indexed texts: (row, tree, text, encoded) from (row, tree, text, edits).

    ``edits`` is an array of (start, stop, new) in characters, each on the text the one before
    left; null or empty leaves the text as it is. ``encoded`` are the characters encoded anew.
    """
    spark = small_batches(rows.sparkSession)
    encoder = shared_encoder(spark, tokenizer_json(read_ranks(path)), pattern_classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in batches:
            jobs = []
            for sums, text, edits in zip(*(batch.column(c) for c in ("tree", "text", "edits"))):
                tree = Tree(np.array(sums.values.to_numpy(), dtype=np.int64).reshape(-1, 2))
                jobs.append(_edits(tree, text.as_py() or "", edits.as_py() or ()))
            found = run_all(own, jobs)
            trees = [tree.sums.reshape(-1) for tree, _, _ in found]
            ends = np.cumsum([0, *map(len, trees)])
            flat = np.concatenate(trees) if trees else np.zeros(0)
            yield pa.record_batch(
                {
                    "row": batch.column("row"),
                    "tree": lists(flat.astype(np.int32), ends),
                    "text": pa.array([text for _, text, _ in found], pa.string()),
                    "encoded": pa.array([work for _, _, work in found], pa.int64()),
                }
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "tree", "text", "edits").mapInArrow(
        run, f"row {kind}, tree array<int>, text string, encoded long"
    )


@query()
def op2_token_counts(spark, sf_dir):
    """Token counts of ``documents``, before and after an edit in the middle of each.

    The edit replaces the 20 characters from floor(n_chars / 2) on by the text's first 30;
    ``reencoded_chars`` is what was encoded for it.
    """
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    text = whole_text("row.text")
    middle = F.floor(F.length(text) / 2).cast("int")
    change = F.array(F.struct(middle.alias("start"), (middle + 20).alias("stop"), F.substring(text, 1, 30).alias("new")))
    before = index(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    rows = before.select(
        F.struct("row.doc_id", F.col("tree")[2].alias("n_chars"), F.col("tree")[3].alias("n_tokens")).alias("row"),
        "tree",
        text.alias("text"),
        change.alias("edits"),
    )
    return recount(rows, path).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.n_chars").cast("long").alias("n_chars"),
        F.col("row.n_tokens").cast("long").alias("n_tokens"),
        F.col("tree")[3].cast("long").alias("edited_tokens"),
        F.col("encoded").alias("reencoded_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"),
    )
