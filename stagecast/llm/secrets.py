"""Secret scans: single credentials, and weak ones linked to their counterparts.

Some findings are credentials by their own form (the base kinds). Others are weak: an
identifier that names an account, a random-looking string, an address of a service. Weak
candidates are reported only if complementary parts stand together within one scope: an
account needs a secret, an opaque string an access part, an endpoint both. An interval join
over scope cells finds them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import keyed_join, query, row_key, small_batches, table, whole_text
from stagecast.session import materialise

#: Characters within which complementary parts belong together.
SCOPE = 160

# The base kinds, in the order in which spans of equal start are listed.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so shorter ones need no match
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))

# Weak kinds: the part of a credential that each can be, its pattern and least length.
WEAK = (
    ("account", "access", re.compile(r"\b(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([\w.@+-]+)", re.ASCII | re.IGNORECASE), 1, 3),
    ("opaque", "secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"), 0, 20),
    ("endpoint", "endpoint", re.compile(r"\b[a-z][a-z0-9+.-]{0,20}://[^\s\"'<>]+|\b(?:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[\w.:-]+", re.ASCII | re.IGNORECASE), 0, 6),
)
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
#: The part that a kind plays: base kinds are strong, they count as counterparts as well.
PART = {"assign": "secret", "access": "access", "hex": "secret"} | {k: part for k, part, *_ in WEAK}

SPAN = "struct<kind:int,start:int,stop:int>"


#: Words without one of which a text can't match; looking for them is much cheaper.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "account": ("user", "login", "client", "account")}


def _may_match(kind: str, lowered: str) -> bool:
    return kind not in HINTS or any(h in lowered for h in HINTS[kind])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base kinds, by start and kind; characters, stop exclusive."""
    spans, lowered = [], text.lower()
    for kind, (name, pattern, group, least) in enumerate(BASE):
        if not _may_match(name, lowered):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                spans.append((kind, *m.span()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def _random_looking(token: str) -> bool:
    """Whether a string mixes letters of both cases with digits, as keys do and words don't."""
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token))


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and stops of the stretches that spans, sorted by start, cover; overlapping ones are one."""
    starts, stops = [], []
    for start, stop in spans:
        if stops and start < stops[-1]:
            stops[-1] = max(stops[-1], stop)
        else:
            starts.append(start)
            stops.append(stop)
    return starts, stops


def masked(text: str, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """The text with every stretch that the spans, sorted by start, cover replaced by ``mask``."""
    starts, stops = merged(spans)
    return mask.join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)]))


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates outside the strong spans; none where no access part is in the text."""
    firsts, lasts = merged([(a, b) for _, a, b in strong])
    spans, lowered = [], text.lower()
    access = any(PART[KINDS[kind]] == "access" for kind, _, _ in strong)
    for kind, (name, part, pattern, group, least) in enumerate(WEAK, len(BASE)):
        if not _may_match(name, lowered) or part != "access" and not access:
            continue
        for m in pattern.finditer(text):
            start, stop = m.span(group)
            if stop - start < least or part == "secret" and not _random_looking(m[group]):
                continue
            before = bisect_left(firsts, stop)  # merged spans that begin before this one's end
            if not before or lasts[before - 1] <= start:
                spans.append((kind, start, stop))
                access = access or part == "access"
    return spans


def _structs(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([s for r in rows for s in r], dtype=np.int32).reshape(-1, 3)
    fields = [pa.array(flat[:, i]) for i in range(3)]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["kind", "start", "stop"]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        strong = [base_spans(t) for t in texts]
        weak = [weak_spans(t, s) for t, s in zip(texts, strong)]
        rows = batch.drop_columns(["text"])
        yield rows.append_column("strong", _structs(strong)).append_column("weak", _structs(weak))


def candidates(docs: DataFrame) -> DataFrame:
    """(rid, rhash, strong, weak) of every row of documents (doc_id, text), with arrays of spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), whole_text().alias("text")).select(*row_key(), "text")
    return rows.mapInArrow(_scan, f"rid {kind}, rhash long, strong array<{SPAN}>, weak array<{SPAN}>")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, rhash, spans): the weak spans whose scope holds the other parts of a credential.

    Rows with the same key are looked at once. A span's scope reaches ``scope`` characters
    to both sides. A weak span is put in the cells of that width that its scope touches, the
    others in all cells that they touch themselves, so the interval join is an equi-join on
    document and cell with the distance as a residue. Spans of one kind don't overlap, so a
    cell has no more members than characters of each kind; pairs that meet in several cells
    fall together in the grouping. A weak span is kept if its scope holds an access part and
    a secret part, itself counted.
    """
    parts = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (k, PART[name])])
    both = F.concat("strong", "weak")
    rows = found.filter(F.size("weak") > 0).dropDuplicates(["rid", "rhash"])
    spans = rows.select("rid", "rhash", F.explode(both).alias("s")).select("rid", "rhash", "s.*")
    spans = spans.withColumn("part", parts[F.col("kind")])
    weak = spans.filter(F.col("kind") >= len(BASE))
    cell = lambda c: F.floor(F.col(c) / scope).cast("long")
    wide = weak.withColumn("cell", F.explode(F.sequence(cell("start") - 1, cell("stop") + 1)))
    other = spans.select(
        F.col("rid").alias("orid"), F.col("rhash").alias("orhash"), F.col("start").alias("ostart"),
        F.col("stop").alias("ostop"), F.col("part").alias("opart"),
        F.explode(F.sequence(cell("start"), cell("stop"))).alias("ocell"),
    ).distinct()
    near = wide.join(
        other,
        F.col("rid").eqNullSafe(F.col("orid"))
        & (F.col("rhash") == F.col("orhash"))
        & (F.col("cell") == F.col("ocell"))
        & (F.col("part") != F.col("opart"))
        & (F.col("ostart") < F.col("stop") + scope)
        & (F.col("start") < F.col("ostop") + scope),
    )
    holds = lambda p: F.max((F.col("part") == p) | (F.col("opart") == p))
    met = near.groupBy("rid", "rhash", "kind", "start", "stop").agg(
        holds("access").alias("access"), holds("secret").alias("secret")
    )
    met = met.filter("access and secret")
    return met.groupBy("rid", "rhash").agg(
        F.collect_list(F.struct("kind", "start", "stop")).alias("spans")
    )


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, rhash, strong, spans) of every row: the base spans and all spans, by start and kind.

    Null and empty texts have no spans; repeated rows each get theirs. Texts are read once; what they gave is kept as a table in the shared folder.
    """
    found = materialise(candidates(docs), "candidates")
    rows = keyed_join(found, linked(found, scope), "left").select(
        "rid", "rhash", "strong",
        F.concat("strong", F.coalesce(F.col("spans"), F.expr(f"cast(array() as array<{SPAN}>)"))).alias("all"),
    )
    by_start = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return rows.select("rid", "rhash", "strong", by_start.alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])
    return F.array_join(F.transform(spans, one), ",")


@query()
def op6_secret_scan(spark, sf_dir):
    """Secrets of every document of ``documents``: counts and digest of base spans, all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("rid").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
        F.sha2(listed("strong").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
