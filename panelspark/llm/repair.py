"""Repair of conversations to `(s?(ua)+)?`: the cheapest edits by layers of cost, and of those the ASCII-least audit.

Four grammar states are bits: 1 before anything, 2 after a system row, 4 after a user row, 8 after an assistant row; 1 and 8 accept. Behind the last row
layer 0 holds the accepting states. Going back row by row, layer c holds every state from which the rest can be repaired
within c more than its cheapest state needs; a row's layers come from the next one's, cost after cost, by shifted copies (Keep, Rerole, Delete) and
then by Insert from lower layers of the same row. Inserts lead from any state to any that can follow, so all four states always
lie within WIDTH layers, and layers are normalised to them: few different ones exist, and each step is looked up once made. The first layer that holds state 1 before the first
row gives the cost. The trace goes forward over the same bits with the set of states that one audit can be in, taking the least
initial that stays on a cheapest way; so it is the least audit.

Spark deals rows by conversation and sorts them within tasks; a task walks its rows in order and keeps, of one conversation at a time, a few
bytes a row (the row's kind, its layers' number, two 64-bit hashes to know duplicates by), never texts. The audits then meet the rows again, sorted
before them, and the repaired text goes through the digest row by row. A conversation is one task's work: its
audit is one string and its digest one chain over all its rows, whatever the plan.

Defined cases. Nulls in role, text, and in the text `conv_id:turn` of the damage are one space. A null conv_id is one conversation. Rows of equal turn
come by role, then text (bytes), after damage, so that repeated ones are adjacent; repeated input rows are rows each. A role's initial is its first character; other roles
than those of initials s, u, a can be reroled or deleted only. Other columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES, ACCEPTS, WIDTH = (START, SYSTEM, USER, ASSISTANT), START | ASSISTANT, 8
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}


def before(states: int, roles: str) -> int:
    """States from which a row of one of these role initials leads into `states`."""
    return sum({s for r in roles for s, t in NEXT.get(r, {}).items() if t & states})


def after(states: int, roles: str) -> int:
    return sum({t for r in roles for s, t in NEXT.get(r, {}).items() if s & states})


def _inserts(layers: list[int]) -> list[int]:
    for c in range(len(layers)):
        layers[c] |= (layers[c - 1] if c else 0) | (before(layers[c - INSERT], "ua") if c >= INSERT else 0)
    return layers


END = tuple(_inserts([ACCEPTS] + [0] * (WIDTH - 1)))


@lru_cache(maxsize=None)
def step(layers: tuple[int, ...], role: str, truncated: bool, must_go: bool) -> tuple[tuple[int, ...], int]:
    """Layers in front of a row, from those behind it; how much more their cheapest state needs. role: an initial, '' for others."""
    reach = 2 * WIDTH
    wide = list(layers) + [layers[-1]] * reach
    new, more = [0] * (reach + WIDTH), TRUNCATED * truncated
    for c in range(len(new)):
        found = wide[c - DELETE] if c >= DELETE else 0
        if not must_go:
            if c >= more:
                found |= before(wide[c - more], role)
            if c >= more + REROLE:
                found |= before(wide[c - more - REROLE], "ua")
        new[c] = found
    new = _inserts(new)
    shift = next(c for c, states in enumerate(new) if states)
    out = tuple(new[shift : shift + WIDTH])
    assert out[-1] == 15
    return out, shift


def _at(layers: tuple[int, ...], cost: int) -> int:
    """States whose cheapest rest costs exactly `cost` above the layers' least."""
    if not 0 <= cost < WIDTH:
        return 0
    return layers[cost] & ~(layers[cost - 1] if cost else 0)


@lru_cache(maxsize=None)
def trace(states: int, layers: tuple[int, ...], behind: tuple[int, ...], shift: int, role: str, truncated: bool, must_go: bool) -> tuple[str, int]:
    """The least initials from these states up to the end of a row, and the states they can be in behind it."""
    letters, more = "", TRUNCATED * truncated

    def take(edit: str) -> int:
        out = 0
        for s in STATES:
            if not s & states:
                continue
            rest = next(c for c, held in enumerate(layers) if held & s)
            if edit == "D":
                out |= s & _at(behind, rest + shift - DELETE)
            elif edit == "I":
                out |= after(s, "ua") & _at(layers, rest - INSERT)
            elif not must_go and edit == "K":
                out |= after(s, role) & _at(behind, rest + shift - more)
            elif not must_go and edit == "R":
                out |= after(s, "ua") & _at(behind, rest + shift - more - REROLE)
        return out

    while True:
        edit, reached = next((e, r) for e in "DIKR" if (r := take(e)))
        letters, states = letters + edit, reached
        if edit != "I":
            return letters, states


@lru_cache(maxsize=None)
def ending(states: int) -> str:
    letters = ""
    while not states & _at(END, 0):
        reached = 0
        for s in STATES:
            if s & states:
                rest = next(c for c, held in enumerate(END) if held & s)
                reached |= after(s, "ua") & _at(END, rest - INSERT)
        letters, states = letters + "I", reached
    return letters


def repaired(kinds: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit for rows of (role initial, truncated, to be deleted)."""
    names: dict[tuple[int, ...], int] = {END: 0}
    known, numbers, shifts, cost = [END], [0], [], 0
    layers = END
    for kind in reversed(kinds):
        layers, shift = step(layers, *kind)
        if layers not in names:
            names[layers] = len(known)
            known.append(layers)
        numbers.append(names[layers])
        shifts.append(shift)
        cost += shift
    cost += next(c for c, held in enumerate(layers) if held & START)
    numbers, shifts = np.array(numbers, np.int32)[::-1], np.array(shifts, np.int8)[::-1]
    states, letters = START, []
    for t, kind in enumerate(kinds):
        edits, states = trace(states, known[numbers[t]], known[numbers[t + 1]], int(shifts[t]), *kind)
        letters.append(edits)
    return cost, "".join(letters) + ending(states)


def output_roles(audit: str) -> tuple[int, int]:
    """Number of rows kept or inserted, and 1 if a system row leads."""
    n = len(audit) - audit.count("D")
    return n, n % 2


class Conversation:
    """What one conversation's rows, seen in order, add up to."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.first, self.last = conv_id, 0, None, None
        self.kinds: list[tuple[str, bool, bool]] = []
        self.blanks: list[bool] = []
        self.hashes = array("q")
        self.illegal, self.initial = 0, None

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, high: int, low: int) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None:
            self.illegal += (self.initial + initial) not in LEGAL
        self.initial = initial
        self.kinds.append(KINDS[initial if initial in NEXT else "", bool(truncated), False])
        self.blanks.append(blank)
        self.hashes.append(high)
        self.hashes.append(low)

    def result(self) -> tuple:
        n = len(self.kinds)
        blank = np.array(self.blanks, bool)
        seen = np.zeros(n, bool)
        high, low = np.frombuffer(self.hashes, np.int64).reshape(n, 2).T if n else (blank, blank)
        order = np.lexsort((low, high))  # stable: the earliest of equal rows leads
        a, b = order[:-1], order[1:]
        seen[b[(high[a] == high[b]) & (low[a] == low[b])]] = True
        duplicate = seen & ~blank
        for i in np.flatnonzero(blank | seen):
            self.kinds[i] = KINDS[self.kinds[i][0], False, True]
        truncated = sum(kind[1] for kind in self.kinds)
        cost, audit = repaired(self.kinds)
        gaps = self.last - self.first + 1 - self.turns if self.last is not None else 0
        return self.conv_id, gaps, int(blank.sum()), int(duplicate.sum()), truncated, self.illegal, cost, audit


KINDS = {k: k for k in ((r, t, m) for r in ("s", "u", "a", "") for t in (False, True) for m in (False, True))}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage; a row that is dropped leaves one whose role and text are null."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = own("role"), own("text")
    case = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    changed = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    row = F.struct(F.when(case != 0, F.when(case == 4, "user").otherwise(role)).alias("role"), F.when(case != 0, changed).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.explode(F.when(case == 3, F.array(row, row)).otherwise(F.array(row))).alias("r"))
    return rows.select("conv_id", "turn", "r.role", "r.text")


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit of each conversation."""
    body = F.rtrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    blank, end = body == "", F.right(body, F.lit(1))
    truncated = ~blank & ~end.isin(".", "!", "?")
    keyed = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.md5(keyed)
    high, low = (F.conv(F.substring(digest, a, 16), 16, -10).cast("long") for a in (1, 17))
    narrow = _sorted(rows).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), truncated.alias("truncated"), high.alias("high"), low.alias("low"), F.col("role").isNotNull().alias("there"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Conversation | None = None
        done: list[tuple] = []
        for batch in batches:
            for conv_id, turn, initial, blank_, cut, high_, low_, there in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.result())
                    current = Conversation(conv_id)
                if there:
                    current.add(turn, initial, blank_, cut, high_, low_)
            if done:
                yield _record(done)
                done = []
        if current is not None:
            yield _record([current.result()])

    return narrow.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())], ["conv_id", *COUNTS, "audit"])


class Rewritten:
    """The repaired rows of one conversation, given its audit first and then its rows in order, as `role:text` pieces."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        _, self.system = output_roles(audit)

    def _role(self) -> str:
        return "user" if (self.out - self.system) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield f"{self._role()}:"
            self.at, self.out = self.at + 1, self.out + 1

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit != "D":
            yield f"{role if edit == 'K' else self._role()}:{text}"
            self.out += 1
        self.at += 1


def repaired_rows(rows: DataFrame, found: DataFrame, spans: int = 1_000) -> DataFrame:
    """The rows of each repaired conversation in order: conv_id, position, line (`role:text`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _walk(batches, spans):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines], pa.int64()), pa.array([x[2] for x in lines], pa.string())], ["conv_id", "position", "line"])

    return _with_audits(rows, found).select("conv_id", "role", "text", "audit").mapInArrow(run, "conv_id long, position long, line string")


def _walk(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    lines, conv, state = [], None, None

    def emit(pieces: Iterator[str]) -> None:
        for piece in pieces:
            lines.append((conv, state.out, piece))

    for batch in batches:
        for conv_id, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if state is not None:
                    emit(state.inserted())
                conv, state = conv_id, Rewritten(audit)
            elif role is not None:
                emit(state.row(role, text))
            if len(lines) >= most:
                yield lines
                lines = []
    if state is not None:
        emit(state.inserted())
    if lines:
        yield lines


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows after damage with each conversation's audit row before its first."""
    heads = found.withColumn("body", F.lit(False))
    both = heads.unionByName(rows.withColumn("body", F.lit(True)), allowMissingColumns=True)
    return _sorted(both, "body")


def repair(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, the counts, cost, audit, repaired_sha256."""
    rows = damaged(conversations)
    found = _with_audits(rows, audits(rows)).select("conv_id", "role", "text", "audit", *COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state, digest, n = None, None, None, 0
        done: list[tuple] = []

        def emit(pieces: Iterator[str]) -> None:
            nonlocal n
            for piece in pieces:
                digest.update(("\n" + piece if n else piece).encode())
                n += 1

        def close() -> None:
            emit(state.inserted())
            done.append((*head, digest.hexdigest()))

        for batch in batches:
            for conv_id, role, text, audit, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if state is not None:
                        close()
                    head, state, digest, n = (conv_id, *counts, audit), Rewritten(audit), hashlib.sha256(), 0
                elif role is not None:
                    emit(state.row(role, text))
            if done:
                yield _finished(done)
                done.clear()
        if state is not None:
            close()
            yield _finished(done)

    return found.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.string()) for c in columns[-2:]], ["conv_id", *COUNTS, "audit", "repaired_sha256"])
