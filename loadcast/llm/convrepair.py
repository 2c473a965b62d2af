"""Conversation repair: the cheapest edits that give a conversation a legal order of roles.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` runs
over the sorted stream and carries the state of a dynamic programme from one
Arrow batch to the next, so no conversation is ever held as a whole.  The state
is small: for each state of the role automaton the least cost so far, its rank
among equal costs, and a copied SHA-256 state of the text repaired so far.  What
grows with a conversation are its backpointers, three bytes a row, which go to an
unnamed file of the task once there are many, where Spark itself spills, and are
read back from its end.  Nobody else reads it: a lost executor repeats the task.

Repeated rows are found before, on digests: a row of another turn that says the
same in the same role marks later ones, and the marks join the sorted stream.

Roles are legal if their initials read ``(s?(ua)+)?``.  Edits are Delete, Insert
(an empty user or assistant turn), Keep and Rerole (to user or assistant).
"""

from __future__ import annotations

import hashlib
import os
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast.llm.text import BLANK

# Workers get this module's functions with the task, wherever the package lives.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# States: nothing yet, behind a system turn, behind a user turn, behind an assistant turn.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
STATES, LEGAL_ENDS = 4, (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
FAR = 1 << 62

# Backpointers held in memory; each is six bits a state.
POINTERS = 1 << 18
ROWS_OUT = 256

REPORT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damage(turns: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) as a faulty crawl would give them.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties
    its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user.  A
    null, of the key as of role and text, counts as one space.
    """
    named = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    left = named.withColumn("fate", fate).filter("fate <> 0").withColumn("again", F.explode(times))
    return left.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): its faults, the cheapest edits, and a digest of the repaired text.

    Columns: conv_id, gaps (turn numbers missing between the first and the last),
    blank, duplicate, truncated (rows by their first fault: no character but white
    space; role and text of an earlier row; a last character other than ``.!?``),
    illegal (neighbours whose initials are not su, ua or au), cost, audit (initials
    of the edits; of equally cheap ones the least), repaired_sha256 (of the lines
    ``role:text``).

    Rows are taken by turn, nulls first; rows of the same turn by role, then by
    the MD5 of their text, so repeated rows stand together.  A null role or text
    counts as one space.  A role whose initial is not s, u or a, an empty one
    too, cannot be kept.  A null conv_id is a conversation.  Other columns are
    ignored.  An empty table gives an empty one.
    """
    kind = turns.schema["conv_id"].dataType
    done = _in_order(_rows(turns).unionByName(_marks(_rows(turns)))).mapInPandas(_repairs, REPORT)
    return done.select(F.col("conv").cast(kind).alias("conv_id"), *[c for c in done.columns if c != "conv"])


def repair_report(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conv_id, also those of which no row is left."""
    found = repair(damage(turns)).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns after the edits that ``repair`` found, inserted ones with edit I."""
    kind = turns.schema["conv_id"].dataType
    rows = _rows(turns).withColumn("audit", F.lit(None).cast("string"))
    plans = repairs.select(F.col("conv_id").cast("string").alias("conv"), "audit")
    plans = rows.limit(0).unionByName(plans, allowMissingColumns=True).withColumn("row", F.lit(-1))
    schema = "conv string, position long, edit string, role string, text string"
    sort = ["conv", F.expr("row = -1").desc(), "turn_order", "role", "digest"]
    done = rows.unionByName(plans).repartition("conv").sortWithinPartitions(*sort).mapInPandas(_applied, schema)
    return done.select(F.col("conv").cast(kind).alias("conv_id"), "position", "edit", "role", "text")


def _rows(turns: DataFrame) -> DataFrame:
    """Turns in the layout of the stream; ids as text, since pandas has no nullable integers."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").alias("turn_order"),
        F.col("turn").cast("string").alias("turn"),
        role.alias("role"),
        F.md5(text).alias("digest"),
        F.lit(1).alias("row"),
        text.alias("text"),
        F.when(~text.rlike(f"[^{BLANK}]"), "blank").when(~text.rlike(rf"[.!?][{BLANK}]*\z"), "truncated").otherwise("").alias("fault"),
    )


def _marks(rows: DataFrame) -> DataFrame:
    """One row before all rows of a turn that repeat those of an earlier turn."""
    said = rows.filter("fault <> 'blank'").select("conv", "turn_order", "turn", "role", "digest").distinct()
    earlier = Window.partitionBy("conv", "role", "digest").orderBy("turn_order")
    later = said.withColumn("nth", F.row_number().over(earlier)).filter("nth > 1").drop("nth")
    return rows.limit(0).unionByName(later.withColumn("row", F.lit(0)), allowMissingColumns=True)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", "turn_order", "role", "digest", "row")


def _options(usable: bool, truncated: bool, initial: str) -> list[list[tuple[str, int, int]]]:
    """Per state: (letters, cost, state) of inserting turns and then editing a row, in the order of the letters."""
    out = []
    for state in range(STATES):
        found, reached = [], state
        for inserts in range(3):
            paid = INSERT * inserts
            letters = "I" * inserts
            found.append((letters + "D", paid + DELETE, reached))
            if usable:
                extra = paid + (TRUNCATED if truncated else 0)
                if (reached, initial) in NEXT:
                    found.append((letters + "K", extra, NEXT[reached, initial]))
                found.append((letters + "R", extra + REROLE, NEXT[reached, NEEDED[reached]]))
            reached = NEXT[reached, NEEDED[reached]]
        out.append(sorted(found))
    return out


def _spill_dir() -> str | None:
    """Where Spark's own Python workers spill."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class _Pointers:
    """Numbers in the order they come, read back from the last; many go to a file."""

    def __init__(self):
        self.held, self.file, self.blocks = bytearray(), None, 0

    def add(self, number: int) -> None:
        self.held += number.to_bytes(3, "little")
        if len(self.held) == 3 * POINTERS:
            self.file = self.file or tempfile.TemporaryFile(dir=_spill_dir())
            self.file.seek(self.blocks * 3 * POINTERS)
            self.file.write(self.held)
            self.blocks += 1
            self.held = bytearray()

    def backwards(self) -> Iterator[int]:
        block, at = bytes(self.held), self.blocks
        while True:
            for i in range(len(block) - 3, -1, -3):
                yield int.from_bytes(block[i : i + 3], "little")
            if not at:
                break
            at -= 1
            self.file.seek(at * 3 * POINTERS)
            block = self.file.read(3 * POINTERS)
        if self.file:
            self.file.close()


# Letters of a step, as numbers that fit four bits beside the state before it.
STEPS = sorted({i + e for i in ("", "I", "II") for e in "DKR"})
STEP_NUMBER = {letters: n for n, letters in enumerate(STEPS)}


def _written(text, state: int, letters: str, row: tuple[str, str] | None):
    """The digest state after the edits ``letters``, the last of them of ``row``."""
    text = text.copy()
    for letter in letters:
        if letter == "D":
            continue
        needed = NEEDED[state]
        if letter == "K":
            role, said = row
            state = NEXT[state, role[:1]]
        else:
            role, said = ROLES[needed], row[1] if letter == "R" else ""
            state = NEXT[state, needed]
        # a line break before every line but the first: only an untouched state has none before it
        text.update(f"{role}:{said}".encode() if text.fresh else f"\n{role}:{said}".encode())
        text.fresh = False
    return text


class _Text:
    """A SHA-256 state that knows whether anything went in."""

    def __init__(self, sha=None, fresh: bool = True):
        self.sha, self.fresh = sha or hashlib.sha256(), fresh

    def copy(self) -> _Text:
        return _Text(self.sha.copy(), self.fresh)

    def update(self, data: bytes) -> None:
        self.sha.update(data)


class _Conversation:
    """The programme's state between two rows of one conversation."""

    options: dict[tuple[bool, bool, str], list] = {}

    def __init__(self, conv: str | None):
        self.conv = conv
        self.costs = [0, FAR, FAR, FAR]
        self.order = [0]  # states that can be reached, by the letters that lead there
        self.texts = [_Text(), None, None, None]
        self.pointers = _Pointers()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.turn = None
        self.initial = self.said = self.marked = None

    def row(self, turn: str | None, role: str, digest: str, text: str, fault: str) -> None:
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
        if fault != "blank" and ((turn, role, digest) == self.said or (turn, role, digest) == self.marked):
            fault = "duplicate"
        self.turn, self.said = turn, (turn, role, digest)
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL_PAIRS
        self.initial = initial
        self._step((fault in ("", "truncated"), fault == "truncated", initial if initial in "sua" else ""), role, text)

    def _step(self, kind: tuple[bool, bool, str], role: str, text: str) -> None:
        if kind not in self.options:
            self.options[kind] = _options(*kind)
        best: list = [None] * STATES
        costs = [FAR] * STATES
        # states in the order of their letters, letters in theirs: of equal costs the first is the least
        for rank, state in enumerate(self.order):
            for letters, cost, to in self.options[kind][state]:
                total = self.costs[state] + cost
                if total < costs[to]:
                    costs[to], best[to] = total, (rank, letters, state)
        reached = [s for s in range(STATES) if best[s]]
        number = 0
        texts: list = [None] * STATES
        for s in reached:
            _, letters, before = best[s]
            number |= (before | STEP_NUMBER[letters] << 2) << 6 * s
            texts[s] = _written(self.texts[before], before, letters, (role, text))
        self.pointers.add(number)
        self.costs, self.texts = costs, texts
        self.order = sorted(reached, key=lambda s: best[s][:2])

    def end(self) -> tuple:
        ends = []
        for rank, state in enumerate(self.order):
            reached = state
            for inserts in range(3):
                if reached in LEGAL_ENDS:
                    ends.append((self.costs[state] + INSERT * inserts, rank, "I" * inserts, state))
                reached = NEXT[reached, NEEDED[reached]]
        cost, _, tail, state = min(ends)
        digest = _written(self.texts[state], state, tail, None).sha.hexdigest()
        parts = [tail]
        for number in self.pointers.backwards():
            step = number >> 6 * state & 63
            state = step & 3
            parts.append(STEPS[step >> 2])
        gaps = int(self.high) - int(self.low) + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, cost, "".join(reversed(parts)), digest)


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    columns = ["conv", "turn", "role", "digest", "row", "text", "fault"]
    now, done = None, []
    for batch in batches:
        for conv, turn, role, digest, row, text, fault in batch[columns].itertuples(index=False, name=None):
            conv, turn = (None if x is None or x != x else x for x in (conv, turn))
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.end())
                now = _Conversation(conv)
            if row:
                now.row(turn, role, digest, text, fault)
            else:
                now.marked = (turn, role, digest)
            if len(done) >= ROWS_OUT:
                yield pd.DataFrame(done, columns=names)
                done = []
    if now is not None:
        done.append(now.end())
    if done:
        yield pd.DataFrame(done, columns=names)


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "position", "edit", "role", "text"]
    columns = ["conv", "row", "role", "text", "audit"]
    out: list = []
    audit, at, state, position, of = "", 0, 0, 0, None

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal state, position
        state, position = NEXT[state, role[:1]], position + 1
        out.append((of, position, edit, role, text))

    def inserted() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            emit("I", ROLES[NEEDED[state]], "")
            at += 1

    for batch in batches:
        for conv, row, role, text, plan in batch[columns].itertuples(index=False, name=None):
            if row == -1:  # the plan comes before the rows of its conversation
                inserted()
                audit, at, state, position, of = plan, 0, 0, 0, None if conv is None or conv != conv else conv
                continue
            inserted()
            letter = audit[at]
            at += 1
            if letter != "D":
                emit(letter, role if letter == "K" else ROLES[NEEDED[state]], text)
            if len(out) >= ROWS_OUT:
                yield pd.DataFrame(out, columns=names)
                out.clear()
    inserted()
    if out:
        yield pd.DataFrame(out, columns=names)
