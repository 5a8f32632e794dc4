"""Byte-level BPE encoding with offsets, and decoding."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import cuts, lists, query, small_batches, table, text_slices, whole_text
from stagecast.llm.pretokens import Encoder, gather, pattern_classes

#: Bytes of text worked on at once; a longer document is a piece of its own.
SLICE = 1 << 19
#: Pre-tokens that the library encodes in one call; its results take several hundred bytes each.
PIECES = 1 << 13


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others for the code points from
    256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have to be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def merge_of(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``, found with the merges of lower rank."""
    parts, own = [token[i : i + 1] for i in range(len(token))], rank[token]
    while len(parts) > 2:
        pairs = [rank.get(a + b, own) for a, b in zip(parts, parts[1:])]
        best = min(pairs)
        if best >= own:
            return None  # made by no merge: such a token only stands for a whole pre-token
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts) if len(parts) == 2 else None


def tokenizer_json(tokens: list[bytes]) -> str:
    """A tokenizers-library BPE model, without special tokens, from tokens by rank."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    char = byte_characters()
    spell = lambda token: "".join(char[b] for b in token)
    rank = {t: i for i, t in enumerate(tokens)}
    merges = [m for t in tokens if len(t) > 1 and (m := merge_of(t, rank))]
    vocab = {spell(t): i for i, t in enumerate(tokens)}
    model = models.BPE(vocab, [(spell(a), spell(b)) for a, b in merges], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


@lru_cache(maxsize=2)
def _encoder(model: str, classes: bytes) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.encode_special_tokens = True

    def ids(pieces: list[str]) -> list[list[int]]:
        groups = (pieces[i : i + PIECES] for i in range(0, len(pieces), PIECES))
        return [e.ids for some in groups for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    return Encoder(np.frombuffer(classes, dtype=np.uint8), ids)


def shared_encoder(spark, model: str, classes: np.ndarray):
    """A function that gives a Python worker its encoder; model and classes have fixed sizes."""
    sent = spark.sparkContext.broadcast((model, classes.tobytes()))
    return lambda: _encoder(*sent.value)


def offsets(ids: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of each token's text.

    ``lengths`` are the bytes of each id. Tokens that split a character all cover it.
    """
    stops = np.cumsum(lengths[ids])
    starts = stops - lengths[ids]
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[stops - 1] + 1


def token_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token begins in the pool of all tokens' bytes, its length, and the pool."""
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), dtype=np.uint8)


def encode(docs: DataFrame, path: str, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """Documents with their text's token ids in place of all they have but their columns.

    The result has one struct column ``row`` with all columns of ``docs`` (so that none can
    clash) and ``ids`` array<int>; with offsets also ``starts`` and ``stops``, the characters
    each token covers. The ranks at ``path`` are read on the driver. Null texts count as
    empty and give no ids; repeated rows stay; an empty table gives an empty table.
    """
    spark = small_batches(docs.sparkSession)
    tokens = read_ranks(path)
    encoder = shared_encoder(spark, tokenizer_json(tokens), pattern_classes())
    sizes = spark.sparkContext.broadcast(token_table(tokens)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                ids, ends = own.rows(raw, bounds)
                columns = {"row": rows.column("row"), "ids": lists(ids, ends)}
                if with_offsets:
                    base = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds[:-1]]
                    for name, at in zip(("starts", "stops"), offsets(ids, sizes.value, raw)):
                        at = at - np.repeat(base, np.diff(ends))
                        columns[name] = lists(at.astype(np.int32), ends)
                yield pa.record_batch(columns)

    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    more = ", starts array<int>, stops array<int>" if with_offsets else ""
    rows = docs.select(F.struct("*").alias("row"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, f"row {kind}, ids array<int>{more}")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes that the ids stand for (null ids: null).

    A character split between tokens is whole again once their bytes stand side by side;
    cast ``decoded`` to string for the text. An id outside the vocabulary is an error.
    """
    starts_lengths_pool = small_batches(rows.sparkSession).sparkContext.broadcast(token_table(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, pool = starts_lengths_pool.value
        for batch in batches:
            counts = np.array(batch.column(ids).value_lengths().fill_null(0), dtype=np.int64)
            for a, b in cuts(counts, SLICE // 4):
                rows = batch.slice(a, b - a)
                flat = rows.column(ids).flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lengths[flat])])
                bounds = ends[np.concatenate([[0], np.cumsum(counts[a:b])])]
                data = gather(flat, starts, lengths, pool)
                whole = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
                )
                whole = pa.compute.if_else(rows.column(ids).is_null(), None, whole.cast(pa.binary()))
                yield rows.append_column("decoded", whole)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, decoded binary")


@query()
def op1_byte_bpe(spark, sf_dir):
    """Token counts of ``documents`` and digests of the ids, the offsets and the decoded bytes."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, with_offsets=True)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    places = F.concat_ws(";", listed("starts"), listed("stops")).cast("binary")
    coded = coded.select(F.col("row.doc_id").alias("doc_id"), "ids", F.sha2(places, 256).alias("offsets_sha256"))
    return decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed("ids").cast("binary"), 256).alias("ids_sha256"),
        "offsets_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
