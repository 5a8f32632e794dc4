"""Conversation structure repair: the cheapest edits that make roles take turns.

A conversation is repaired if its roles' initials read s?(ua)+ or nothing is left of it. Rows
may be kept, given another role or deleted, and empty ones inserted. A depth-first
branch-and-bound finds the cheapest edits, of equal ones the first audit by code points: nodes
are (rows read, role before), suffix lower bounds give what the rest costs at least, the
incumbent is the best (cost, audit) so far, and a table per node drops prefixes that are no
better than one that reached it before.

Edits depend on the rows' roles and faults alone. One pass over small rows in turn order finds
them, a second one streams the texts past them, so no conversation's texts are ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast.llm.common import query, small_batches, table
from stagecast.session import materialise

# What the edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEPARATORS = " \t\n\v\f\r"
#: Roles so far: none, the system's, then turns of user and assistant. The initials that may follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
COMPLETE = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: The step a row without a role of its own takes: a reroled or inserted one.
TURN = tuple({r: s for r, s in step.items() if r in NAMES} for step in NEXT)
FAULTLESS, CUT_SHORT, USELESS = "", "t", "d"


def suffix_bounds(rows: list[tuple[str, str]]) -> list[list[int]]:
    """For each number of rows read and each role before, what the rest costs at least.

    Worked out from the last row on; the best repair of the rest meets its bound.
    """
    far = INSERT * (2 * len(rows) + 4)
    after = [0 if s in COMPLETE else far for s in range(4)]
    bounds = []
    for i in range(len(rows), -1, -1):
        if i == len(rows):
            here = after
        else:
            initial, fault = rows[i]
            here = []
            for state in range(4):
                costs = [DELETE + bounds[-1][state]]
                if fault != USELESS:
                    more = TRUNCATED if fault == CUT_SHORT else 0
                    costs += [more + KEEP + bounds[-1][s] for r, s in NEXT[state].items() if r == initial]
                    costs += [more + REROLE + bounds[-1][s] for s in TURN[state].values()]
                here.append(min(costs))
        here = list(here)
        for _ in range(3):  # at most three insertions lead from any role to any other
            for state in range(4):
                here[state] = min([here[state], *(INSERT + here[s] for s in TURN[state].values())])
        bounds.append(here)
    return bounds[::-1]


def repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows given as (initial, fault).

    Prefixes are tried in the order of their audits. So a prefix that reaches a node later
    has a later audit and only matters if it is cheaper, and so has a later solution: the
    incumbent is replaced by cheaper ones only. Two audits of equal cost never are one the
    beginning of the other, as only insertions, which cost, could make the difference. What
    is on the stack when the first solution is found costs as much and is dropped by its bound.
    """
    n = len(rows)
    bounds = suffix_bounds(rows)
    reached = [[None] * 4 for _ in range(n + 1)]
    best, found = None, None
    stack = [(0, START, 0, None)]  # rows read, role before, cost, audit as (edits before, edit)
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None and cost + bounds[i][state] >= best:
            continue
        if reached[i][state] is not None and cost >= reached[i][state]:
            continue
        reached[i][state] = cost
        if i == n and state in COMPLETE:
            best, found = cost, audit
            continue
        ways = []
        if i < n:
            initial, fault = rows[i]
            ways.append(("D", i + 1, state, DELETE))
            if fault != USELESS:
                more = TRUNCATED if fault == CUT_SHORT else 0
                ways += [("K", i + 1, s, KEEP + more) for r, s in NEXT[state].items() if r == initial]
                ways += [("R", i + 1, s, REROLE + more) for s in TURN[state].values()]
        ways += [("I", i, s, INSERT) for s in TURN[state].values()]
        least = bounds[i][state]
        for edit, j, s, step in sorted(ways, reverse=True):
            # an edit that the bound rules out of the cheapest repairs of the rest is not tried
            if step + bounds[j][s] <= least:
                stack.append((j, s, cost + step, (audit, edit)))
    edits = []
    while found:
        found, edit = found
        edits.append(edit)
    return best, "".join(reversed(edits))


@lru_cache(maxsize=1 << 16)
def _repaired(signature: str) -> tuple[int, str]:
    return repair([(signature[i], signature[i + 1].strip()) for i in range(0, len(signature), 2)])


def steps(audit: str, initials: str | None = None) -> Iterator[tuple[str, str | None]]:
    """(edit, new role) of an audit, given the initials of its rows: the role of rows that get one."""
    state, at = START, 0
    for edit in audit:
        if edit == "K":
            state = NEXT[state][initials[at]]
            yield edit, None
        elif edit == "D":
            yield edit, None
        else:
            ((role, state),) = TURN[state].items()
            yield edit, NAMES[role]
        at += edit != "I"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations as (conv_id, turn, role, text, dropped) with damage by a hash of id and turn.

    Rows that the damage drops stay, marked; rows that it repeats come twice. Null roles,
    texts, ids and turns are read as one space (ids and turns for the hash alone).
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    found = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return found.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        copies.alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by conversation, each conversation's in turn order (null turns first, ties by digest)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *columns, F.col("turn").asc_nulls_first(), "digest"
    )


def _digest() -> Column:
    """A digest of role and text, the role's length first, so that neither can pass for the other."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


ANALYSED = [
    *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()),
    ("initials", pa.string()),
]


class _Found:
    """The rows of one conversation as they come by in order."""

    def __init__(self, conv_id):
        self.conv_id, self.signature, self.before = conv_id, [], None
        self.turns, self.first, self.last = 0, None, None
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, initial: str, blank: bool, short: bool, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        again = digest in self.seen
        self.seen.add(digest)
        self.counts["blank"] += blank
        self.counts["duplicate"] += again and not blank
        self.counts["truncated"] += short and not blank and not again
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.signature.append(initial + ("d" if blank or again else "t" if short else " "))

    def row(self) -> tuple:
        signature = "".join(self.signature)
        cost, audit = _repaired(signature) if len(signature) <= 64 else _repaired.__wrapped__(signature)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), cost, audit, signature[::2])


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, kind, done = None, None, []

    def made() -> pa.RecordBatch:
        schema = pa.schema([("conv_id", kind), *ANALYSED])
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "initial", "blank", "short", "digest"))
        for conv_id, turn, dropped, *row in zip(*columns):
            if own is None or conv_id != own.conv_id:
                if own is not None:
                    done.append(own.row())
                own = _Found(conv_id)
            if not dropped:
                own.add(turn, *row)
        if len(done) >= 512:
            yield made()
            done = []
    if own is not None:
        done.append(own.row())
        yield made()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the repaired conversations: each comes as its audit first, then its rows."""
    kind, done, current, edits, digest, lines = None, [], None, iter(()), None, 0

    def write(role: str, text: str) -> None:
        nonlocal lines
        digest.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
        lines += 1

    def insertions() -> tuple[str, str | None]:
        """Write the rows to insert here; the edit of the next row."""
        for edit, role in edits:
            if edit != "I":
                return edit, role
            write(role, "")
        return "", None

    def close() -> None:
        if current is not None:
            insertions()
            done.append((current, digest.hexdigest()))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "audit", "initials", "role", "text"))
        for conv_id, audit, initials, role, text in zip(*columns):
            if audit is not None:
                close()
                current, edits, digest, lines = (conv_id,), steps(audit, initials), hashlib.sha256(), 0
                continue
            edit, new = insertions()
            if edit != "D":
                write(new or role, text)
        if len(done) >= 512:
            yield _digests(done, kind)
            done = []
    close()
    if done:
        yield _digests(done, kind)


def _digests(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch(
        {"conv_id": pa.array([c for (c,), _ in done], kind), "repaired_sha256": pa.array([d for _, d in done])}
    )


def analyse(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, initials) per conversation.

    ``rows`` are (conv_id, turn, role, text, dropped). A null conv_id is a conversation of
    its own. Rows of equal turns come by digest of role and text, so repeated ones are
    neighbours. Dropped rows count for nothing; a conversation of which none is left has
    zeros and an empty audit.
    """
    small_batches(rows.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    shown = F.rtrim("text", F.lit(SEPARATORS))
    blank, last = shown == "", F.substring(shown, -1, 1)
    initial = F.when(F.length("role") == 0, " ").otherwise(F.substring("role", 1, 1))
    light = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "dropped", initial.alias("initial"),
        blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("short"), _digest().alias("digest"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in ANALYSED)
    return _ordered(light).mapInArrow(_analyse, f"conv_id {kind}, {counts}")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digests of the lines ``role:text`` after the edits of ``analyse``.

    The audit of a conversation travels in front of its rows; texts stream past it.
    """
    kept = rows.filter("not dropped").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", _digest().alias("digest"))
    nothing = F.lit(None).cast("string")
    kept = kept.withColumns({"audit": nothing, "initials": nothing, "part": F.lit(1)})
    heads = found.select("conv_id", "audit", "initials", F.lit(0).alias("part"))
    both = heads.unionByName(kept, allowMissingColumns=True)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _ordered(both, "part").mapInArrow(_stream, f"conv_id {kind}, repaired_sha256 string")


def repair_all(rows: DataFrame) -> DataFrame:
    """What ``analyse`` finds, with the digest of the repaired conversation."""
    found = materialise(analyse(rows), "repairs")
    digests = repaired(rows, found).withColumnRenamed("conv_id", "other")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("other"))).drop("other", "initials")


@query()
def op11_conversation_repair(spark, sf_dir):
    """Repairs of every conversation of ``conversations`` after its rows were damaged."""
    return repair_all(damaged(table(spark, sf_dir, "conversations")))
