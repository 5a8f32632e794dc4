import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from data import colliding, documents, empty, rows
from tokenizers import Tokenizer

from stagecast.llm import alignment, bpe

A, B = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("piece_bpe_32k.model")
ALPHABET = "ab  '\n\t sStTre1 é中9!?.<|>́²😀\x00▁"


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in enumerate(bpe.byte_characters())}

    def tokens(text):
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        a_bytes = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            piece = two.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode())
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], [], [], []
        return a, b, a_bytes, b_bytes

    return tokens


def slow(tokens, texts):
    docs, held = [], defaultdict(set)
    for d, text in enumerate(texts):
        a, b, a_bytes, b_bytes = tokens(text or "")
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, i, j = [], Counter(), 0, 0
        for end in sorted({*a_ends} & {*b_ends}):
            p, q = a[i : a_ends.index(end, i) + 1], b[j : b_ends.index(end, j) + 1]
            i, j = i + len(p), j + len(q)
            groups.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
            links.update((x, y) for x in p for y in q)
        for pair in links:
            held[pair].add(d)
        docs.append((a, b, groups, links))
    best = defaultdict(int)
    for (x, _), where in held.items():
        best[x] = max(best[x], len(where))
    out = []
    for a, b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(n for pair, n in links.items() if len(held[pair]) == best[pair[0]])
        total = sum(n * len(held[pair]) for pair, n in links.items())
        out.append((len(a), len(b), len(groups), sum(links.values()), sha, n_best, total))
    pairs = {pair: (len(where), sum(links[pair] for *_, links in docs)) for pair, where in held.items()}
    return out, pairs


def check(spark, tokens, texts, ids=None):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    found, pairs = alignment.align(docs, A, B)
    got = sorted(found.collect(), key=lambda r: r.row.doc_id)
    want, want_pairs = slow(tokens, texts)
    assert [tuple(r)[1:] for r in got] == want
    assert {(r.a, r.b): (r.documents, r.links) for r in pairs.collect()} == want_pairs


def texts_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_units_give_the_model_s_ids(libraries):
    with open(B, "rb") as f:
        encoder = alignment.PieceEncoder(f.read())
    texts = [t for t in texts_of(1, 20000) + [" ", "  ", "a ", "a  b   c ", "<s> <0x0A>", *colliding()] if t and "▁" not in t]
    parts = [(" " + t).encode() for t in texts]
    bounds = np.cumsum([0, *map(len, parts)])
    ids, ends = encoder.rows(np.frombuffer(b"".join(parts), np.uint8), bounds)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [encoder.model.encode(t) for t in texts]


def test_small_documents(spark, libraries, monkeypatch):
    texts = [*texts_of(2, 400), None, "", " ", "  ", "a▁b", "<|endoftext|> </s>", "don't stop", "don't stop", "x" * 3000, " " * 500, "中文字" * 40]
    check(spark, libraries, texts)


def test_dense_bitmaps_and_large_groups(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "DENSE", 3)
    monkeypatch.setattr(alignment, "SMALL", 1)
    check(spark, libraries, [*texts_of(3, 200), *["the same text again"] * 20, "ab" * 400])


def test_packed_postings():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 30000):
        pairs, docs = rng.integers(0, 5, n), rng.integers(0, 60000, n)
        times = rng.integers(1, 300, n)
        found = alignment.packed(pairs, docs, times)
        want = defaultdict(int)
        for p, d, t in zip(pairs.tolist(), docs.tolist(), times.tolist()):
            want[p, d] += t
        got_docs, got_times = alignment.unpacked(found["docs"], found["numbers"], found["bits"], found["planes"])
        assert list(zip(np.repeat(found["pairs"], found["docs"]).tolist(), got_docs.tolist(), got_times.tolist())) == [
            (p, d, t) for (p, d), t in sorted(want.items())
        ]
        assert found["links"].sum() == times.sum()


def test_rows(spark, libraries):
    found, pairs = alignment.align(documents(spark), A, B)
    got = {r.row.row: tuple(r)[1:] for r in found.collect()}
    want, _ = slow(libraries, [r[1] for r in rows()])
    assert got == dict(enumerate(want))
    found, pairs = alignment.align(empty(spark), A, B)
    assert found.collect() == [] and pairs.collect() == []
