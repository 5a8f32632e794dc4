"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Byte offsets at which tokens of both tokenizers end cut a text into groups; every token of a
group is linked with every token of the other tokenizer in it. The links are kept as an
inverted index. Documents are numbered within chunks; for each pair of ids a chunk holds a
compressed bitmap of its documents (a sorted list of numbers, or plain bits where there are
many) and, as bit planes over that list, how often each document holds the pair. Bitmaps of
a pair are merged within a chunk and popcounted; as chunks share no document, the counts of
a pair over all chunks add up. The postings then return each pair's score to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stagecast.llm.bpe import byte_characters, shared_encoder, token_table, vocabulary
from stagecast.llm.common import query, small_batches, table, text_slices, whole_text
from stagecast.llm.pretokens import Encoder, gather, library_classes
from stagecast.session import materialise

#: Bytes of text worked on at once, and of a chunk; a longer document is a chunk of its own.
SLICE, CHUNK = 1 << 19, 4 << 20
#: Documents of a chunk at most, so that their numbers take 16 bits.
DOCS = 1 << 16
#: Documents above which plain bits are shorter than a list of numbers.
DENSE = DOCS // 16
#: Pairs of a group up to which its links are written out before they are counted.
SMALL = 64
#: Distinct units that each of the two encoders of a worker keeps.
KEPT = 500_000
SPACE_MARK = "▁"


class PieceEncoder(Encoder):
    """A sentencepiece model over units of spaces with the other characters after them.

    No piece holds a space mark after another character (checked when the model is read), so
    no merge crosses from one unit to the next and each distinct unit is encoded once. Every
    row has to begin with a space: the one that the model would put there.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {i} goes on over a space")
        alone = [self.model.piece_to_id(SPACE_MARK)]
        super().__init__(
            None, lambda units: [i or alone for i in self.model.encode([u[1:] for u in units], num_threads=1)]
        )

    def begins(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A unit begins with the row and with each space after another character."""
        begins = first.copy()
        begins[1:] |= (points[1:] == 32) & (points[:-1] != 32)
        return begins


def byte_level_tokens(model: str) -> list[bytes]:
    """The bytes of each entry of a byte-level tokenizer file, by id."""
    from tokenizers import Tokenizer

    byte = {c: b for b, c in enumerate(byte_characters())}
    vocab = Tokenizer.from_str(model).get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        tokens[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return tokens


def piece_tokens(model: bytes) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model, by id."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    one = lambda i: pieces.id_to_piece(i)
    return [
        bytes([int(one(i)[3:-1], 16)]) if pieces.is_byte(i) else one(i).replace(SPACE_MARK, " ").encode()
        for i in range(pieces.get_piece_size())
    ]


@lru_cache(maxsize=2)
def _piece_encoder(model: bytes) -> PieceEncoder:
    return PieceEncoder(model)


@lru_cache(maxsize=4)
def _printed(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal numbers below n, each followed by a comma, a bar and a semicolon, as a token table."""
    return token_table([f"{i}{mark}".encode() for mark in ",|;" for i in range(n)])


def spelled(ids: np.ndarray, rows: np.ndarray, tokens, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the tokens of each row join to the row's bytes."""
    starts, lengths, pool = tokens
    made = gather(ids, starts, lengths, pool)
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[rows]
    same = np.diff(ends) == np.diff(bounds)
    if same.all():
        same[np.searchsorted(bounds, np.nonzero(made != raw)[0], side="right") - 1] = False
    else:
        for i in np.nonzero(same)[0]:
            same[i] = np.array_equal(made[ends[i] : ends[i + 1]], raw[bounds[i] : bounds[i + 1]])
    return same


class Groups:
    """Groups of some rows: token ids of both sides, the group of each token, the row of each group."""

    def __init__(self, one, other, one_lengths: np.ndarray, other_lengths: np.ndarray):
        (self.a, a_rows), (self.b, b_rows) = one, other
        a_ends, b_ends = np.cumsum(one_lengths[self.a]), np.cumsum(other_lengths[self.b])
        size = int(a_ends[-1]) if len(a_ends) else 0
        ends = np.zeros(size + 1, dtype=np.uint8)
        ends[a_ends] += 1
        ends[b_ends] += 1
        a_last, b_last = ends[a_ends] == 2, ends[b_ends] == 2
        self.a_group, self.b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        self.n = int(a_last.sum())
        self.p = np.bincount(self.a_group, minlength=self.n)
        self.q = np.bincount(self.b_group, minlength=self.n)
        # a row's last byte ends a group, so its groups follow from its tokens
        self.edges = np.concatenate([[0], np.cumsum(a_last)])[a_rows]
        self.row = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, row, times) of all links: pair is a * ``width`` + b; a pair may come repeatedly.

        Of large groups only the distinct ids are paired, with the product of their numbers.
        """
        sizes = self.p * self.q
        a_first, b_first = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q
        small = np.nonzero(sizes <= SMALL)[0]
        group = np.repeat(small, sizes[small])
        k = np.arange(len(group)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
        a, b = self.a[a_first[group] + k // self.q[group]], self.b[b_first[group] + k % self.q[group]]
        pairs, rows, times = [a.astype(np.int64) * width + b], [self.row[group]], [np.ones(len(group), np.int64)]
        for g in np.nonzero(sizes > SMALL)[0]:
            a, m = np.unique(self.a[a_first[g] : a_first[g] + self.p[g]], return_counts=True)
            b, n = np.unique(self.b[b_first[g] : b_first[g] + self.q[g]], return_counts=True)
            pairs.append((a.astype(np.int64)[:, None] * width + b).ravel())
            times.append((m[:, None] * n).ravel())
            rows.append(np.full(len(pairs[-1]), self.row[g]))
        return np.concatenate(pairs), np.concatenate(rows), np.concatenate(times)

    def printed(self, a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all rows as bytes, each row with a last semicolon, and their bounds."""
        size = max(a_size, b_size)
        starts, lengths, pool = _printed(size)
        before_a = np.cumsum(self.q) - self.q
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        a_last = np.append(self.a_group[1:] != self.a_group[:-1], True)[: len(self.a)]
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True)[: len(self.b)]
        codes[np.arange(len(self.a)) + before_a[self.a_group]] = self.a + np.where(a_last, size, 0)
        codes[np.arange(len(self.b)) + np.cumsum(self.p)[self.b_group]] = self.b + np.where(b_last, 2 * size, 0)
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        tokens = np.concatenate([[0], np.cumsum(self.p + self.q)])[self.edges]
        return gather(codes, starts, lengths, pool), ends[tokens]


def kept_rows(ids: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the rows to keep; the others stay as rows without tokens."""
    sizes = np.diff(rows)
    return ids[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(np.where(keep, sizes, 0))])


def packed(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> dict:
    """The postings of a chunk: per pair its documents' bitmap, its planes, its counts.

    Repeated (pair, document) entries are merged. ``docs`` lists the bitmaps' popcounts and
    ``links`` the planes' popcounts, each plane weighted by its power of two.
    """
    order = np.argsort(pairs * DOCS + docs, kind="stable")
    pairs, docs, times = pairs[order], docs[order], times[order]
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]) | (docs[1:] != docs[:-1])
    at = np.nonzero(fresh)[0]
    pairs, docs = pairs[at], docs[at]
    times = np.add.reduceat(times, at) if len(at) else times
    first = np.ones(len(pairs), dtype=bool)
    first[1:] = pairs[1:] != pairs[:-1]
    heads = np.nonzero(first)[0]
    sizes = np.diff(np.append(heads, len(pairs)))
    listed = np.repeat(sizes <= DENSE, sizes)
    bits = []
    for i in np.nonzero(sizes > DENSE)[0]:
        plain = np.zeros(DOCS, dtype=np.uint8)
        plain[docs[heads[i] : heads[i] + sizes[i]]] = 1
        bits.append(np.packbits(plain))
    planes = [np.packbits((times >> k & 1).astype(np.uint8)) for k in range(int(times.max()).bit_length() if len(times) else 0)]
    return {
        "pairs": pairs[heads],
        "docs": sizes,
        "links": np.add.reduceat(times, heads) if len(heads) else times,
        "numbers": docs[listed].astype("<u2").tobytes(),
        "bits": b"".join(b.tobytes() for b in bits),
        "planes": b"".join(p.tobytes() for p in planes),
    }


def unpacked(sizes: np.ndarray, numbers: bytes, bits: bytes, planes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and times of all postings of a chunk, pair after pair."""
    total = int(sizes.sum())
    listed = np.repeat(sizes <= DENSE, sizes)
    docs = np.empty(total, dtype=np.int64)
    docs[listed] = np.frombuffer(numbers, "<u2")
    if bits:
        plain = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, DOCS)
        docs[~listed] = np.nonzero(plain)[1]
    width = (total + 7) // 8
    times = np.zeros(total, dtype=np.int64)
    for k in range(len(planes) // width if width else 0):
        times |= np.unpackbits(np.frombuffer(planes, np.uint8, width, k * width), count=total).astype(np.int64) << k
    return docs, times


CHUNK_FIELDS = "pairs array<bigint>, docs array<bigint>, links array<bigint>, numbers binary, bits binary, planes binary"
DOC_FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _index(encoders, sizes, kind: pa.DataType):
    """Rows of documents (chunk, doc, row, counts) and, for each chunk, a row with its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        one, other = (e() for e in encoders)
        one.kept = other.kept = KEPT
        a_table, b_table = sizes.value
        chunk, docs, size, links = TaskContext.get().partitionId() << 24, 0, 0, []

        def filled(n: int, columns: dict) -> pa.RecordBatch:
            return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def postings() -> Iterator[pa.RecordBatch]:
            if links:
                found = packed(*(np.concatenate(x) for x in zip(*links)))
                made = {k: pa.array([v], schema.field(k).type) for k, v in found.items()}
                yield filled(1, made | {"chunk": pa.array([chunk], pa.int64())})

        longs = pa.list_(pa.int64())
        fields = [("chunk", pa.int64()), ("doc", pa.int32()), ("row", kind)]
        fields += [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())]
        fields += [(n, longs) for n in ("pairs", "docs", "links")] + [(n, pa.binary()) for n in ("numbers", "bits", "planes")]
        schema = pa.schema(fields)
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                if docs and (size + len(raw) > CHUNK or docs + len(rows) > DOCS):
                    yield from postings()
                    chunk, docs, size, links = chunk + 1, 0, 0, []
                a, b = one.rows(raw, bounds), other.rows(raw, bounds)
                keep = spelled(*a, a_table, raw, bounds) & spelled(*b, b_table, raw, bounds)
                a, b = kept_rows(*a, keep), kept_rows(*b, keep)
                groups = Groups(a, b, a_table[1], b_table[1])
                pairs, row, times = groups.links(len(b_table[1]))
                links.append((pairs, row + docs, times))
                text, ends = groups.printed(len(a_table[1]), len(b_table[1]))
                text = text.tobytes()
                digests = [sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends.tolist(), ends[1:].tolist())]
                n_links = np.concatenate([[0], np.cumsum(groups.p * groups.q)])[groups.edges]
                counts = {"n_a": np.diff(a[1]), "n_b": np.diff(b[1]), "n_groups": np.diff(groups.edges), "n_links": np.diff(n_links)}
                yield filled(
                    len(rows),
                    {k: pa.array(v, pa.int64()) for k, v in counts.items()}
                    | {
                        "chunk": pa.array(np.full(len(rows), chunk)),
                        "doc": pa.array(np.arange(docs, docs + len(rows)), pa.int32()),
                        "row": rows.column("row"),
                        "groups_sha256": pa.array(digests),
                    },
                )
                docs, size = docs + len(rows), size + len(raw)
        yield from postings()

    return run


def _returned(chunk: pa.Table, scores: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk, from its postings and its pairs' scores."""
    schema = pa.schema([("chunk", pa.int64()), ("doc", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    if not chunk.num_rows:
        return schema.empty_table()
    row = chunk.select(["at", "numbers", "bits", "planes"]).to_pylist()[0]
    sizes = chunk.column("docs").combine_chunks().flatten().to_numpy()
    docs, times = unpacked(sizes, row["numbers"], row["bits"], row["planes"])
    order = np.argsort(scores.column("pair").to_numpy())
    count, best = (scores.column(c).to_numpy()[order] for c in ("documents", "best"))
    sums = np.zeros((2, int(docs.max()) + 1 if len(docs) else 0), dtype=np.int64)
    np.add.at(sums[0], docs, times * np.repeat(best, sizes))
    np.add.at(sums[1], docs, times * np.repeat(count, sizes))
    n = sums.shape[1]
    columns = [np.full(n, row["at"]), np.arange(n, dtype=np.int32), sums[0], sums[1]]
    return pa.table([pa.array(c) for c in columns], schema=schema)


def index(docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """The inverted index of two tokenizers' links over documents, as a table in the shared folder.

    It has a row for each document (chunk, doc, row with all columns of ``docs``, n_a, n_b,
    n_groups, n_links, groups_sha256) and one for each chunk with its postings (doc null).
    ``byte_level`` is a file of the tokenizers library, ``pieces`` a sentencepiece model, both
    read on the driver. Texts that are null, empty or not spelled by both sides' tokens have
    none. Repeated rows each count as a document; an empty table gives an empty index.
    """
    from tokenizers import Tokenizer

    spark = small_batches(docs.sparkSession)
    with open(byte_level, encoding="utf-8") as f:
        model = f.read()
    with open(pieces, "rb") as f:
        proto = f.read()
    own = shared_encoder(spark, model, library_classes(Tokenizer.from_str(model)))
    sent = spark.sparkContext.broadcast(proto)
    tables = spark.sparkContext.broadcast((token_table(byte_level_tokens(model)), token_table(piece_tokens(proto))))
    spaced = F.when(whole_text(text) == "", "").otherwise(F.concat(F.lit(" "), whole_text(text)))
    rows = docs.select(F.struct("*").alias("row"), spaced.alias("text"))
    kind = rows.schema["row"].dataType
    run = _index((own, lambda: _piece_encoder(sent.value)), tables, to_arrow_type(kind))
    schema = f"chunk bigint, doc int, row {kind.simpleString()}, {DOC_FIELDS}, {CHUNK_FIELDS}"
    return materialise(rows.mapInArrow(run, schema), "alignment")


def pair_counts(indexed: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, documents, links, best): each id pair's counts over the whole corpus.

    ``width`` is the number of ids of the second tokenizer; ``best`` says whether no other pair
    of the first id is in more documents.
    """
    counted = _entries(indexed).groupBy("pair").agg(F.sum("docs").alias("documents"), F.sum("links").alias("links"))
    a = F.floor(F.col("pair") / width).cast("long")
    counted = materialise(counted.withColumn("a", a).withColumn("b", F.col("pair") - F.col("a") * width), "pairs")
    most = counted.groupBy("a").agg(F.max("documents").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))


def _entries(indexed: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pairs", "docs", "links")).alias("e")
    chunks = indexed.filter("doc is null")
    return chunks.select("chunk", zipped).select("chunk", F.col("e.pairs").alias("pair"), F.col("e.docs").alias("docs"), F.col("e.links").alias("links"))


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the pairs of ids with their counts.

    The documents come as (row, n_a, n_b, n_groups, n_links, groups_sha256, n_best,
    count_sum), one for each row of ``docs``; the pairs as ``pair_counts`` gives them. A pair
    in a third of all documents is one row for each chunk; a chunk's postings and scores are
    what one task holds, and their size follows CHUNK.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    indexed = index(docs, byte_level, pieces, text)
    pairs = materialise(pair_counts(indexed, width), "pair-scores")
    scores = _entries(indexed).join(pairs, "pair").select("chunk", "pair", "documents", F.col("best").cast("long").alias("best"))
    chunks = indexed.filter("doc is null").select(F.col("chunk").alias("at"), "docs", "numbers", "bits", "planes")
    found = chunks.groupBy("at").cogroup(scores.groupBy("chunk")).applyInArrow(
        _returned, "chunk bigint, doc int, n_best bigint, count_sum bigint"
    )
    known = indexed.filter("doc is not null")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    fields = [f.split()[0] for f in DOC_FIELDS.split(", ")]
    rows = known.join(found, ["chunk", "doc"], "left").select("row", *fields, zero("n_best"), zero("count_sum"))
    return rows, pairs


@query()
def op12_tokenizer_alignment(spark, sf_dir):
    """Groups, links and pair counts of the two vocabularies' tokens in every document of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
