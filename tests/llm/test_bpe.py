"""Encoding against another library, exact round trips, offsets, edit-aware counts."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from data import colliding, documents, empty, rows
from tokenizers import Tokenizer

from stagecast.llm import bpe, counts, pretokens

RANKS = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab  '\n\t\r sStTrevmld1 é中9!?'.<|>́²Ⅷ😀\x85 \x1c"


@pytest.fixture(scope="module")
def other():
    import public_tokenizers

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe._encoder(bpe.tokenizer_json(bpe.read_ranks(RANKS)), pretokens.pattern_classes().tobytes())


def encoded(encoder, texts):
    parts = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, parts)])
    ids, ends = encoder.rows(np.frombuffer(b"".join(parts), np.uint8), bounds)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_same_ids_as_another_library(encoder, other):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 25))) for _ in range(20000)]
    assert encoded(encoder, texts) == [other.encode_ordinary(t) for t in texts]


def test_every_code_point(encoder, other):
    points = [c for c in range(0x3200) if not 0xD800 <= c < 0xE000] + list(range(0x1F000, 0x1F100))
    texts = [f"a{chr(c)}b1{chr(c)}1!{chr(c)}! {chr(c)} a  {chr(c)}" for c in points]
    assert encoded(encoder, texts) == [other.encode_ordinary(t) for t in texts]


def test_memory_that_starts_afresh(encoder, other, monkeypatch):
    monkeypatch.setattr(pretokens, "KEPT", 5)
    encoder.forget()
    for text in ("one two three four five six seven", "one eight nine", "ten two one"):
        assert encoded(encoder, [text]) == [other.encode_ordinary(text)]


def test_words_that_collide(encoder, other, spark):
    assert encoded(encoder, colliding()) == [other.encode_ordinary(t) for t in colliding()]
    docs = spark.createDataFrame(list(enumerate(colliding())), "doc_id long, text string")
    assert all(r.decoded == r.row.text.encode() for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect())
    for r in counts.index(docs, RANKS).collect():
        assert r.tree[3] == len(other.encode_ordinary(r.row.text))


def test_equal_hashes_are_told_apart(other):
    own = bpe._encoder.__wrapped__(bpe.tokenizer_json(bpe.read_ranks(RANKS)), pretokens.pattern_classes().tobytes())
    own.hashes.of = lambda points, starts, stops: (stops - starts).astype(np.uint64) % np.uint64(3)
    rng = random.Random(8)
    for _ in range(5):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 25))) for _ in range(500)]
        assert encoded(own, texts) == [other.encode_ordinary(t) for t in texts]


def test_classes_of_a_tokenizer_file():
    tokenizer = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    classes = pretokens.library_classes(tokenizer)
    rng = random.Random(1)
    some = rng.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 3000) + list(range(0x600))
    for c in some:
        text = f"a{chr(c)}b1{chr(c)}1!{chr(c)}! {chr(c)} a  {chr(c)}"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.arange(len(points)) == 0
        got = np.nonzero(pretokens.cut(points, classes[points], first))[0].tolist()
        assert got == [a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_merges_of_a_token():
    rank = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4, b"bcb": 5}
    assert bpe.merge_of(b"abc", rank) == (b"ab", b"c")
    assert bpe.merge_of(b"bcb", rank) is None


def test_rows_round_trip(spark, other):
    found = bpe.decode(bpe.encode(documents(spark), RANKS, with_offsets=True), RANKS).collect()
    assert sorted(r.row.row for r in found) == [r[5] for r in rows()]
    for r in found:
        text = r.row.text or ""
        assert r.ids == other.encode_ordinary(text)
        assert r.decoded == text.encode()
        assert r.row.ids == "clash"
        lengths = [len(other.decode_single_token_bytes(i)) for i in r.ids]
        at = 0
        for start, stop, n in zip(r.starts, r.stops, lengths):
            covered = text[start:stop].encode()
            before = len(text[:start].encode())
            assert before <= at and at + n <= before + len(covered)
            at += n
    assert bpe.encode(empty(spark), RANKS).collect() == []


def test_query_gives_a_digest_of_the_offsets(spark, tmp_path):
    documents(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    whole = bpe.encode(documents(spark), RANKS, with_offsets=True).collect()
    join = lambda values: ",".join(map(str, values))
    want = [(str(r.row.doc_id), hashlib.sha256(f"{join(r.starts)};{join(r.stops)}".encode()).hexdigest()) for r in whole]
    got = [(str(r.doc_id), r.offsets_sha256) for r in bpe.op1_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_split_character_decodes(spark):
    # one character of four bytes, each a token
    rows = spark.createDataFrame([([172, 253, 224, 222],), (None,), ([],)], "ids array<int>")
    tokens = bpe.read_ranks(RANKS)
    want = b"".join(tokens[i] for i in (172, 253, 224, 222))
    assert [r.decoded for r in bpe.decode(rows, RANKS).collect()] == [want, None, b""]


def tree_of(encoder, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, tokens, _ = encoder.counts(raw, np.array([0, len(raw)]))
    return counts.Tree.of(counts.leaves_of(starts, tokens, len(text)))


def test_edits_keep_counts_right(encoder, other, monkeypatch):
    monkeypatch.setattr(counts, "LEAF", 2)
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    texts = [make(rng.randrange(0, 90)) for _ in range(300)]
    trees = [tree_of(encoder, t) for t in texts]
    for _ in range(4):
        edits, want = [], []
        for text in texts:
            a = rng.randrange(0, len(text) + 1)
            b, new = a + rng.randrange(0, 12), make(rng.randrange(0, 12))
            edits.append((a, b, new))
            want.append(text[:a] + new + text[b:])
        found = counts.run_all(encoder, [counts.edit(tree, t, *e) for tree, t, e in zip(trees, texts, edits)])
        trees, texts = [f[0] for f in found], [f[1] for f in found]
        assert texts == want
        for tree, text in zip(trees, texts):
            assert tree.sums[1].tolist() == [len(text), len(other.encode_ordinary(text))]
            assert tree.sums[tree.leaves :].sum(axis=0).tolist() == tree.sums[1].tolist()


def test_edit_of_a_long_text_is_local(encoder):
    text = "some words and numbers 12 34. " * 3000
    ((_, _, work),) = counts.run_all(encoder, [counts.edit(tree_of(encoder, text), text, 40000, 40005, "other")])
    assert work < 1500


def test_counts_of_rows(spark, other):
    found = counts.index(documents(spark), RANKS).collect()
    assert len(found) == len(rows())
    for r in found:
        assert r.tree[2:4] == [len(r.row.text or ""), len(other.encode_ordinary(r.row.text or ""))]
    indexed = counts.index(documents(spark), RANKS)
    edits = "array(struct(0 as start, 2 as stop, 'xyz' as new), struct(900000 as start, 900001 as stop, cast(null as string) as new))"
    changed = counts.recount(indexed.selectExpr("row", "tree", "row.text as text", f"{edits} as edits"), RANKS).collect()
    for r in changed:
        assert r.text == "xyz" + (r.row.text or "")[2:]
        assert r.tree[3] == len(other.encode_ordinary(r.text))
    assert counts.index(empty(spark), RANKS).collect() == []
