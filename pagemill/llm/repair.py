"""Repair of conversations: the cheapest edits that make the roles take turns, by a dynamic program over runs of equal rows."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of an edit, and of a truncated row that stays. Keeping costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What a row is called that holds no text, one that was there before, one that breaks off, and a sound one.
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "-"
#: States: nothing yet, after the system's row, after a user's and after an assistant's; and what follows each by an inserted or re-roled row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
FAR = 1 << 60
#: Runs of more rows than this are unrolled in halves.
UNROLLED = 64

Symbol = tuple[str, str]  # a role's initial and the row's first fault
Vector = tuple[int, ...]  # the cost to the end from each state
Matrix = tuple[Vector, ...]

RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long"
)


def kept_to(state: int, initial: str) -> int | None:
    """The state after keeping a row of that initial, if it may stand here."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def choices(state: int, symbol: Symbol) -> list[tuple[str, int, int]]:
    """(edit, its cost, the state after it) of a row, by the letters of the edits."""
    initial, fault = symbol
    more = TRUNCATED if fault == CUT else 0
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        to = kept_to(state, initial)
        out += [("K", more, to)] if to is not None else []
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def _before(m: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in m)


def _inserts() -> Matrix:
    """Costs of going from one state to another by inserted rows: two at most, as a third leads back."""
    rows = []
    for q in range(4):
        row = [FAR] * 4
        row[q], one, two = 0, NEXT[q], NEXT[NEXT[q]]
        row[one] = min(row[one], INSERT)
        row[two] = min(row[two], 2 * INSERT)
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()
#: Cost to the end from each state when no row is left.
END: Vector = _before(INSERTS, tuple(0 if q in ENDS else FAR for q in range(4)))


@lru_cache(maxsize=1024)
def power(symbol: Symbol, k: int) -> Matrix:
    """The transition of 2**k rows of a symbol: inserts, then an edit, each time. There are a dozen symbols, so all powers in use are kept."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    edit = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        for _, cost, to in choices(q, symbol):
            edit[q][to] = min(edit[q][to], cost)
    return _times(INSERTS, tuple(map(tuple, edit)))


def advanced(symbol: Symbol, rows: int, v: Vector) -> Vector:
    """The cost to the end before so many rows of a symbol, from what it is after them."""
    k = 0
    while rows:
        if rows & 1:
            v = _before(power(symbol, k), v)
        rows, k = rows >> 1, k + 1
    return v


#: All symbols; a run's is one byte.
SYMBOLS: tuple[Symbol, ...] = tuple((i, f) for i in ("s", "u", "a", "") for f in (BLANK, DUPLICATE, CUT, SOUND))
_CODE = {s: k for k, s in enumerate(SYMBOLS)}
#: Costs are kept after every so many runs, and computed again between when these are unrolled.
MARKED = 512


class Runs:
    """Rows as runs of equal symbols, a few bytes each."""

    def __init__(self, symbols: Iterable[Symbol] = ()) -> None:
        self.codes, self.counts = bytearray(), array("Q")
        for symbol in symbols:
            self.add(symbol)

    def add(self, symbol: Symbol) -> None:
        code = _CODE[symbol]
        if self.codes and self.codes[-1] == code:
            self.counts[-1] += 1
        else:
            self.codes.append(code)
            self.counts.append(1)

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, k: int) -> tuple[Symbol, int]:
        return SYMBOLS[self.codes[k]], self.counts[k]


def costs(runs: Runs) -> tuple[int, list[Vector]]:
    """The least cost of all, and the cost to the end after each MARKED runs and after the last."""
    v, marks = END, []
    for k in range(len(runs) - 1, -1, -1):
        if k == len(runs) - 1 or (k + 1) % MARKED == 0:
            marks.append(v)
        v = advanced(*runs[k], v)
    return v[START], marks[::-1]


def edits(runs: Runs, marks: list[Vector]) -> Iterator[tuple[str, int]]:
    """(edit, state after it) in order: of the cheapest edits those whose letters come first. The letters and the rows tell all else, as a
    role is given by what stands before it. Costs between two marks, and within a run those of its halves, are computed when they are reached, so that
    neither many runs nor a long one are held."""
    state = START

    def inserted(v: Vector, symbol: Symbol | None) -> Iterator[tuple[str, int]]:
        """One row, or none at the end: v is the cost after it, so that of each way to go on is known."""
        nonlocal state
        while True:
            best: tuple[str, int] | None = None
            ways = [] if symbol is None else [(e, c + v[to], to) for e, c, to in choices(state, symbol)]
            least = min([c for _, c, _ in ways], default=0 if state in ENDS else FAR)
            on, row = state, []
            for k in (1, 2):
                on = NEXT[on]
                c = k * INSERT + (min(x + v[to] for _, x, to in choices(on, symbol)) if symbol else 0 if on in ENDS else FAR)
                row.append(c)
            total = min(least, *row)
            for e, c, to in ways:
                if c == total and (best is None or e < best[0]):
                    best = (e, to)
            if min(row) == total and (best is None or best[0] > "I") and (symbol or least > total):
                best = ("I", NEXT[state])
            if best is None:
                return
            state = best[1]
            yield best
            if best[0] != "I":
                return

    def run(symbol: Symbol, rows: int, v: Vector) -> Iterator[tuple[str, int]]:
        if rows > UNROLLED:
            half = rows // 2
            yield from run(symbol, rows - half, advanced(symbol, half, v))
            yield from run(symbol, half, v)
            return
        costs = [v]
        for _ in range(rows - 1):
            costs.append(_before(power(symbol, 0), costs[-1]))
        for cost in reversed(costs):
            yield from inserted(cost, symbol)

    for k, mark in enumerate(marks):
        begin, end = k * MARKED, min((k + 1) * MARKED, len(runs))
        after = [mark]
        for i in range(end - 1, begin, -1):
            after.append(advanced(*runs[i], after[-1]))
        for i in range(begin, end):
            yield from run(*runs[i], after[end - 1 - i])
    yield from inserted(END, None)


class _Conversation:
    """One conversation that streams by: first what its rows are, from which the edits follow, then the rows themselves."""

    def __init__(self, key) -> None:
        self.key, self.runs, self.faults = key, Runs(), dict.fromkeys((BLANK, DUPLICATE, CUT, SOUND), 0)
        self.illegal = self.rows = self.distinct = 0
        self.before = self.turn = self.first = None
        self.audit, self.hash, self.repaired, self.steps = bytearray(), hashlib.sha256(), 0, None

    def seen(self, turn: int | None, initial: str, fault: str) -> None:
        self.rows += 1
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and (self.distinct == 0 or turn != self.turn):
            self.first = turn if self.distinct == 0 else self.first
            self.turn, self.distinct = turn, self.distinct + 1
        self.runs.add((initial if initial in ("s", "u", "a") else "", fault))

    def _put(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.repaired else b"") + role + b":" + text)
        self.repaired += 1

    def _next(self) -> tuple[str, int] | None:
        if self.steps is None:
            self.cost, marks = costs(self.runs)
            self.steps = edits(self.runs, marks)
        for edit, state in self.steps:
            self.audit += edit.encode()
            if edit != "I":
                return edit, state
            self._put(NAMES[state].encode(), b"")
        return None

    def row(self, role: bytes, text: bytes) -> None:
        edit, state = self._next()
        if edit != "D":
            self._put(role if edit == "K" else NAMES[state].encode(), text)

    def end(self) -> tuple:
        self._next()
        gaps = self.turn - self.first + 1 - self.distinct if self.distinct else 0
        f = self.faults
        return (self.key, gaps, f[BLANK], f[DUPLICATE], f[CUT], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest(), self.rows, self.repaired)


def first_fault(role: Column, text: Column, again: Column) -> Column:
    """The first of a row's faults: no visible character, the same role and text earlier in the conversation, no sentence's end at the end."""
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(SOUND)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None) -> DataFrame:
    """A row for each conversation of rows (conversation, turn, role, text), also for those of which no row is left: its id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256, n_rows and n_repaired.

    A conversation's rows go by turn, nulls first; rows of one turn by role and text, so that the result is determined. A null role or text is one
    space; an empty role has no initial and can't be kept. times_col, if given, tells how often a row stands there: 0 leaves none, 2 a row and
    its repetition right after it. Each row's first fault counts: blank, duplicate or truncated (first_fault). gaps are the turns missing between
    the least and the greatest; illegal counts neighbours whose roles' initials aren't su, ua or au.

    The edits are Keep, Rerole, Delete and Insert (costs at the top of this module; a blank or duplicate row must go) that give the roles
    (system? (user assistant)+)?, the cheapest; of equally cheap ones the first by their letters, which are the audit. repaired_sha256 is of the lines
    role:text after them. An empty table gives an empty table; a null conversation is one of its own; other columns are left out.

    Equal neighbours are runs of a symbol; min-plus powers of the symbol's transition, kept for each binary power, carry the cost back over a run,
    whatever its length. Rows are shuffled once, by conversation, and stream by in order: first what each row is, then the rows themselves, so
    that a task holds some bytes for each run and edit and the digest's state, and neither a conversation's texts nor a batch of conversations.
    """
    times = F.coalesce(F.col(times_col), F.lit(1)) if times_col else F.lit(1)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), times.cast("int").alias("times"))
    own = own.repartition("conv")
    copies = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("times"), F.lit(1)) - 1)))
    there = F.col("times") > 0
    # by conversation and more, so the rows lie in the same partition already
    equal = Window.partitionBy("conv", "role", "text", there).orderBy(F.col("turn").asc_nulls_first(), "copy")
    again = F.lag("copy").over(equal).isNotNull() & there
    told = copies.withColumn("again", again).withColumn("fault", F.when(there, first_fault(F.col("role"), F.col("text"), F.col("again"))))
    facts = F.struct(F.lit(0).alias("part"), F.substring("role", 1, 1).alias("role"), F.lit(None).cast("binary").alias("text"))
    itself = F.struct(F.lit(1).alias("part"), F.col("role"), F.col("text").cast("binary").alias("text"))
    both = told.withColumn("is", F.explode(F.when(there, F.array(facts, itself)).otherwise(F.array(facts))))
    order = ["conv", "is.part", "turn", "role", "text", "again"]  # of equal rows the first isn't again
    sorted_ = both.sortWithinPartitions(*order).select("conv", "turn", "fault", F.col("is.part").alias("part"), F.col("is.role").alias("role"), F.col("is.text").alias("text"))
    kind = rows.schema[conv_col].dataType
    names = ["conv_id", *[c.split()[0] for c in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        done: list[tuple] = []
        schema = None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema)], names=names)

        for batch in batches:
            schema = schema or [batch.schema.types[0], *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64()]
            convs, turns, faults, parts, roles = (batch.column(k).to_pylist() for k in range(5))
            texts = batch.column(5)
            for k, conv in enumerate(convs):
                if now is None or conv != now.key:
                    done += [now.end()] if now else []
                    now = _Conversation(conv)
                if faults[k] is None:
                    continue
                if parts[k] == 0:
                    now.seen(turns[k], roles[k], faults[k])
                else:
                    now.row(roles[k].encode(), texts[k].as_py())
            if len(done) >= 2000:
                yield told(done)
                done = []
        if now:
            yield told([*done, now.end()])

    return sorted_.mapInArrow(run, f"conv_id {kind.simpleString()}, {RESULT}")
