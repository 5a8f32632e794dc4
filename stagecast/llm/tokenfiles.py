"""Token ids in files of independent zstandard frames with a seek table.

A file follows the public seekable format of zstandard: frames one after another, each
readable by itself, and at the end a skippable frame with the compressed and decompressed
size and a checksum (the low half of XXH64) of every frame. A frame holds the ids, as
little-endian unsigned 32-bit integers, of whole documents. One more skippable frame lists
the documents: ids and token counts. A reader takes the tables from the end of the file and
decompresses only the frames that hold what it was asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecast.llm.blocks import in_blocks
from stagecast.llm.bpe import SLICE, shared_encoder, vocabulary
from stagecast.llm.common import query, small_batches, table, text_slices, whole_text
from stagecast.llm.pretokens import library_classes
from stagecast.session import materialise, scratch

END_ID = 2
#: Ids after which a frame is closed; a document is never split.
FRAME = 1 << 16
LEVEL = 3

# Fixed values of the seekable format.
SEEK_TABLE, LISTING, FOOTER = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHECKSUMS = 0x80


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file. Documents come in order with their ids as uint32."""

    def __init__(self, stream):
        self.stream, self.frames, self.docs = stream, [], []
        self.waiting, self.size, self.tokens = [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        if self.size >= FRAME:
            self._frame()

    def _frame(self):
        data = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.compressor.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data), _checksum(data)))
        self.waiting, self.size = [], 0

    def close(self):
        if self.waiting:
            self._frame()
        listing = self.compressor.compress(
            np.array([-1 if d is None else d for d, _ in self.docs], "<i8").tobytes()
            + np.array([n for _, n in self.docs], "<u4").tobytes()
            + np.array([d is None for d, _ in self.docs], "u1").tobytes()
        )
        body = struct.pack("<I", len(self.docs)) + listing
        self.stream.write(struct.pack("<II", LISTING, len(body)) + body)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER)
        self.stream.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class Reader:
    """Reads the tables of one file, and documents on demand."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or flags != CHECKSUMS:
            raise ValueError("not a token file")
        table_at = size - 9 - 12 * count - 8
        entries = np.frombuffer(self._at(table_at + 8, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.sizes, self.checks = entries[:, 1], entries[:, 2]
        at = int(self.places[-1])
        n = struct.unpack("<I", self._at(at + 8, 4))[0]
        data = zstandard.ZstdDecompressor().decompress(self._at(at + 12, table_at - at - 12), max_output_size=13 * n)
        missing = np.frombuffer(data, "u1", n, 12 * n).astype(bool)
        self.ids = [None if m else d for d, m in zip(np.frombuffer(data, "<i8", n).tolist(), missing)]
        self.counts = np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)]) // 4
        self.opened = 0  # frames decompressed so far

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def frame(self, k: int) -> np.ndarray:
        self.opened += 1
        packed = self._at(int(self.places[k]), int(self.places[k + 1] - self.places[k]))
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[k]))
        if len(data) != self.sizes[k] or _checksum(data) != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, "<u4")

    def documents(self, numbers: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of the documents with these ascending numbers in the file."""
        last, frame = -1, None
        for i in numbers:
            k = int(np.searchsorted(self.edges, self.starts[i], side="right")) - 1
            if self.counts[i] == 0:
                yield i, np.zeros(0, "<u4")
                continue
            if k != last:
                last, frame = k, self.frame(k)
            at = int(self.starts[i] - self.edges[k])
            yield i, frame[at : at + int(self.counts[i])]


def _open(folder: str):
    """The file system and path of a folder that executors share."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID) -> DataFrame:
    """Encode documents and write their ids, in ascending order of doc_id, to files in ``folder``.

    Returns one row per file: block (the files' order), file, docs, tokens. ``path`` is a file
    of the tokenizers library, read on the driver. Null texts count as empty and get the end
    id alone; null ids come first; rows of equal ids are ordered by text hash. A file is
    written under a name of its own and then moved, so a task that runs twice does no harm.
    """
    from tokenizers import Tokenizer

    spark = small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        model = f.read()
    encoder = shared_encoder(spark, model, library_classes(Tokenizer.from_str(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = _open(folder)
        own, block, writer, name = encoder(), None, None, ""

        def done():
            writer.close()
            store.move(f"{root}/{name}", f"{root}/{block:08d}.ids.zst")
            row = {"block": [block], "file": [f"{block:08d}.ids.zst"], "docs": [len(writer.docs)], "tokens": [writer.tokens]}
            return pa.record_batch(row, schema=found)

        found = pa.schema([("block", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
        for batch in batches:
            for rows, raw, bounds in text_slices(batch, "text", SLICE):
                ids, ends = own.rows(raw, bounds)
                blocks, names = rows.column("block").to_pylist(), rows.column("doc_id").to_pylist()
                for i, (b, doc_id) in enumerate(zip(blocks, names)):
                    if b != block:
                        if writer:
                            yield done()
                        block, name = b, f".{b:08d}-{uuid.uuid4().hex}"
                        writer = Writer(store.open_output_stream(f"{root}/{name}"))
                    some = ids[ends[i] : ends[i + 1]]
                    writer.add(doc_id, some if end_id is None else np.append(some, np.int32(end_id)))
        if writer:
            yield done()

    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows = in_blocks(docs.select("doc_id", whole_text().alias("text")), "doc_id")
    rows = rows.sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.select("block", "doc_id", "text")
    return materialise(rows.mapInArrow(run, "block int, file string, docs long, tokens long"), "files")


def read(files: DataFrame, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids) of the documents in the files that ``write`` listed.

    ``start`` counts the ids of all documents before. With ``wanted`` (block, number), only
    those documents' frames are decompressed; numbers count from 0 in each file.
    """
    before = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per file
    rows = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    if wanted is not None:
        numbers = wanted.groupBy("block").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
        rows = rows.join(numbers, "block")
    else:
        rows = rows.withColumn("numbers", F.lit(None).cast("array<int>"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as stream:
                    file = Reader(stream)
                    numbers = range(len(file.ids)) if row["numbers"] is None else row["numbers"]
                    part, size = [], 0
                    for i, ids in file.documents(numbers):
                        part.append((file.ids[i], row["base"] + int(file.starts[i]), ids))
                        size += len(ids)
                        if size > SLICE:
                            yield _rows(part, schema)
                            part, size = [], 0
                    yield _rows(part, schema)

    return rows.repartition(n, "block").select("file", "base", "numbers").mapInArrow(
        run, "doc_id long, start long, ids array<bigint>"
    )


def _rows(part, schema) -> pa.RecordBatch:
    ids = [p[2] for p in part]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    return pa.record_batch(
        [
            pa.array([p[0] for p in part], pa.int64()),
            pa.array([p[1] for p in part], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
        ],
        schema=schema,
    )


def digests(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files."""
    before = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as stream:
                    file = Reader(stream)
                    crc = [zlib.crc32(ids.tobytes()) for _, ids in file.documents(range(len(file.ids)))]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(file.ids, pa.int64()),
                            "start": pa.array(file.starts[:-1] + row["base"]),
                            "n_tokens": pa.array(file.counts),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    rows = rows.repartition(n, "block").select("file", "base")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query()
def op8_token_files(spark, sf_dir):
    """Token ids of ``documents``, written to files and read back from them."""
    folder = scratch(spark, "token-files")
    files = write(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return digests(files, folder)
