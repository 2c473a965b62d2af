"""Conversation repair against a search over whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

from loadcast.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def in_order(rows):
    """A conversation's (turn, role, text) as the operator takes them."""
    rows = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        if not stripped:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faulty):
    """Dijkstra over (rows done, initials so far as an automaton's prefix): cost, then the edit string itself."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        tail = roles[-2:] if len(roles) > 2 else roles
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, lines
        if (at, tail) in done:
            continue
        done.add((at, tail))

        def push(more, letter, to, role=None, text="", initial=""):
            told = roles + initial
            if any(LEGAL.fullmatch(told + end) for end in ("", "a", "ua")):
                kept = lines if role is None else (*lines, f"{role}:{text}")
                heapq.heappush(heap, (cost + more, audit + letter, to, told, kept))

        for role in ("user", "assistant"):
            push(3, "I", at, role, "", role[0])
        if at < len(rows):
            _, role, text = rows[at]
            push(4, "D", at + 1)
            if faulty[at] in ("", "truncated"):
                extra = 3 if faulty[at] else 0
                if role[:1]:
                    push(extra, "K", at + 1, role, text, role[:1])
                for other in ("user", "assistant"):
                    push(extra + 3, "R", at + 1, other, text, other[0])


def plain(rows):
    convs = {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(row)
    out = {}
    for conv, told in convs.items():
        told = in_order(told)
        faulty = faults(told)
        cost, audit, lines = cheapest(told, faulty)
        turns = [t for t, _, _ in told if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, *[faulty.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest), lines
    return out


def check(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    repairs = convrepair.repair(turns)
    want = plain(rows)
    got = repairs.collect()
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.conv_id][0]
    lines = {}
    for r in convrepair.repaired_turns(turns, repairs).collect():
        lines.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for conv, (_, told) in want.items():
        mine = sorted(lines.get(conv, []))
        assert [p for p, _ in mine] == list(range(1, len(told) + 1)) and tuple(t for _, t in mine) == told


def test_cheapest_edits(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why? \n", "cut off", "", " \t", "é𝄞 so.", "a:b", "user:"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, "", "ass", "é"]
    rows = []
    for conv in range(250):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, turn * 3, None]), rng.choice(roles), rng.choice(texts)))
    check(spark, rows)


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Say {c}, {t}. So!") for c in range(40) for t in range(9)] + [(None, None, None, None), (7, None, "user", "x")]
    got = map(tuple, convrepair.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        want += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    assert sorted(got, key=str) == sorted(want, key=str)
    report = convrepair.repair_report(spark.createDataFrame(rows, SCHEMA))
    assert report.count() == 41 and report.select("conv_id").distinct().count() == 41


def test_conversations_without_rows_left(spark):
    gone = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    row = convrepair.repair_report(spark.createDataFrame([(5, t, "user", "A.") for t in gone], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(5, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert convrepair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_giant_conversation_spills(spark, monkeypatch):
    """Backpointers go to the file in blocks, over several Arrow batches, beside small conversations."""
    monkeypatch.setattr(convrepair, "POINTERS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = random.Random(2)
        rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Well.", "cut", "", f"{t}!"])) for t in range(1500)]
        rows += [(c, t, rng.choice(["user", "assistant"]), "Hm.") for c in range(2, 30) for t in range(3)]
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    rows = [
        (None, 1, "user", "Same id, none."),
        (None, 2, "assistant", None),
        (2**53 + 1, 2**62, "user", "Big ids."),
        (2**53 + 1, 2**62 + 1, "assistant", "Yes."),
        (2**53, 0, "assistant", "Alone."),
        (3, 1, "user", "y" * 300_000 + "."),
        (3, 2, "assistant", "z" * 300_000),
        (4, 1, "user", "Twice."),
        (4, 1, "user", "Twice."),
        (4, 1, "assistant", "Tie."),
    ]
    check(spark, rows)
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'p' as conv", "1 as row", "2 as fault", "'d' as digest", "3 as audit", "4 as turn_order")
    assert convrepair.repair_report(more).count() == 5
