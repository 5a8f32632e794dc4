import io

import numpy as np
import pyarrow as pa
import pytest
from data import colliding, documents, empty, rows
from tokenizers import Tokenizer

from stagecast.llm import tokenfiles
from stagecast.llm.bpe import vocabulary
from stagecast.session import scratch

PATH = vocabulary("byte_bpe_50k.json")


def test_files_round_trip(spark):
    folder = scratch(spark, "ids")
    files = tokenfiles.write(documents(spark), folder, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = sorted(
        (r[0] is not None, r[0] or 0, [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows()
    )
    got = sorted(tokenfiles.read(files, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d if known else None for known, d, _ in want]
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((d, ids) for _, d, ids in want)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    crc = {r.start: r for r in tokenfiles.digests(files, folder).collect()}
    assert [len(r.ids) for r in got] == [crc[r.start].n_tokens for r in got]


def test_words_that_collide(spark):
    folder = scratch(spark, "ids")
    texts = colliding()
    files = tokenfiles.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in tokenfiles.read(files, folder).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_no_documents(spark):
    folder = scratch(spark, "ids")
    files = tokenfiles.write(empty(spark), folder, PATH)
    assert files.collect() == [] and tokenfiles.digests(files, folder).collect() == []


def _file(documents):
    sink = pa.BufferOutputStream()
    writer = tokenfiles.Writer(sink)
    writer.stream = _Open(sink)
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, np.uint32))
    writer.close()
    return sink.getvalue().to_pybytes()


class _Open:
    """A stream whose close keeps the buffer."""

    def __init__(self, sink):
        self.write = sink.write

    def close(self):
        pass


def test_only_wanted_frames_are_opened(monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME", 10)
    docs = [(i, range(i, i + 6)) for i in range(20)] + [(None, []), (99, range(50))]
    reader = tokenfiles.Reader(pa.BufferReader(_file(docs)))
    assert len(reader.sizes) > 5
    assert [(reader.ids[i], ids.tolist()) for i, ids in reader.documents([4, 20, 21])] == [
        (4, [4, 5, 6, 7, 8, 9]), (None, []), (99, list(range(50)))
    ]
    assert reader.opened == 2


def test_damage_is_noticed():
    data = bytearray(_file([(1, range(1000))]))
    data[40] ^= 1
    reader = tokenfiles.Reader(pa.BufferReader(bytes(data)))
    with pytest.raises(Exception):
        list(reader.documents([0]))
    with pytest.raises(ValueError):
        tokenfiles.Reader(pa.BufferReader(bytes(100)))


def test_a_plain_decompressor_reads_the_file():
    import zstandard

    data = _file([(1, [1, 2, 3]), (2, [4])])
    out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(out, "<u4").tolist() == [1, 2, 3, 4]


def test_wanted_documents(spark):
    folder = scratch(spark, "ids")
    files = tokenfiles.write(documents(spark), folder, PATH)
    every = {r.start: r for r in tokenfiles.read(files, folder).collect()}
    block = files.orderBy("block").first()["block"]
    some = tokenfiles.read(files, folder, spark.createDataFrame([(block, 0)], "block int, number int")).collect()
    assert len(some) == 1 and some[0] == every[some[0].start]
