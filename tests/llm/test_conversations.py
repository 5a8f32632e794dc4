import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from stagecast.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost int, digest string"
INK = r"[^\x20\x09-\x0D]"


def cheapest(rows):
    """The best (cost, audit) of every beginning of a right sequence of roles, row by row."""
    good = re.compile(r"(s?(ua)+)?")
    best = {(0, ""): (0, "")}  # (rows read, roles so far) -> (cost, audit)
    most = 2 * len(rows) + 3
    for i in range(len(rows) + 1):
        for length in range(most + 1):
            for (at, roles), (cost, audit) in [x for x in best.items() if x[0][0] == i and len(x[0][1]) == length]:
                ways = [(i, roles + r, 5, "I") for r in "ua"]
                if i < len(rows):
                    initial, fault = rows[i]
                    ways.append((i + 1, roles, 2, "D"))
                    if fault != "d":
                        more = 5 if fault == "t" else 0
                        ways.append((i + 1, roles + initial, more, "K"))
                        ways += [(i + 1, roles + r, 1 + more, "R") for r in "ua"]
                for j, new, step, edit in ways:
                    if len(new) <= most and re.fullmatch("s?(ua)*u?", new):
                        here = (cost + step, audit + edit)
                        best[j, new] = min(best.get((j, new), here), here)
    return min(v for (i, roles), v in best.items() if i == len(rows) and good.fullmatch(roles))


def test_cheapest_edits():
    kinds = [(r, f) for r in "suax" for f in ("", "t", "d")]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert conversations.repair(list(rows)) == cheapest(rows)
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("ssuuaax"), rng.choice(["", "", "", "t", "d"])) for _ in range(rng.randrange(3, 6))]
        assert conversations.repair(rows) == cheapest(rows)


def test_long_conversation():
    rng = random.Random(2)
    rows = [(rng.choice("sua"), rng.choice(["", "", "t", "d"])) for _ in range(20_000)]
    cost, audit = conversations.repair(rows)
    assert len(audit) - audit.count("I") == len(rows)
    assert cost == conversations.suffix_bounds(rows)[0][conversations.START]


def slow(rows):
    """The contract row by row."""
    by_conv = defaultdict(list)
    for conv_id, turn, role, text in rows:
        spaced = [" " if x is None else x for x in (conv_id, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        size = str(len(role))
        order = (turn is not None, turn or 0, hashlib.sha256(f"{size}:{role}{text}".encode()).digest())
        by_conv[conv_id] += [(order, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv_id, found in by_conv.items():
        found.sort(key=lambda r: r[0])
        seen, marks, counts = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in found:
            ink = re.findall(INK, text)
            fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marks.append((role[:1] or " ", "d" if fault in "bd" and fault else fault))
        turns = [t for _, t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marks, marks[1:]))
        cost, audit = cheapest(marks) if len(marks) < 5 else conversations.repair(marks)
        lines, at, last = [], 0, None
        for edit in audit:
            role, text = ("", "") if edit == "I" else found[at][2:]
            at += edit != "I"
            if edit == "D":
                continue
            last = role[:1] if edit == "K" else "a" if last == "u" else "u"
            lines.append(f"{role if edit == 'K' else 'user' if last == 'u' else 'assistant'}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv_id] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return out


def rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", "  \n", "Why? ", "é!\n", None, "long " * 50_000 + ".", "a. ", "b.\x85", ":", "x . \t"]
    out = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 7)):
            turn = rng.choice([turn, turn, turn, turn + 3, None, 0])
            out.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return out + out[:7]


def check(spark, found):
    table = spark.createDataFrame([(*r, 1, "clash") for r in found], SCHEMA)
    got = conversations.repair_all(conversations.damaged(table)).collect()
    want = slow(found)
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[f] for f in fields) for r in got} == want


def test_conversations(spark):
    check(spark, rows(3, 150))


def test_one_conversation_of_many_rows(spark):
    rng = random.Random(4)
    check(spark, [(1, i, rng.choice(["user", "assistant"]), f"text {i}.") for i in range(3000)] + [(2, 5, "user", "Hello.")])


def test_no_conversations(spark):
    check(spark, [])


def test_all_rows_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "gone.")])
