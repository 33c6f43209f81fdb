"""Repair of the turn structure of conversations.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  The
cheapest edits make it so: Keep costs 0, Rerole to user or assistant 1, Delete
2, Insert of an empty user or assistant turn 5.  Blank and duplicate turns must
be deleted; a truncated turn that is not deleted costs 5 more.  Of equally cheap
repairs the one whose edits, written in order, are least in ASCII is taken.

Rows are dealt out by conversation and sorted inside the partitions, and one
stream per partition carries the state of a dynamic program across batches.
Each conversation passes twice in the one sorted stream: first its classes
without texts, last turn first, then its texts, first turn first.  In the first
pass the program runs from the end with four states (nothing yet, after s,
after u, after ua) and pushes one byte of back-pointers per turn, two bits per
state; in the second the bytes are popped, edits follow, and the repaired turns
are written or hashed.  The bytes are in memory up to SPILL and beyond that in
an unnamed file of the task, which nobody else reads and which goes with it, so
a conversation of any length needs bounded memory but for the audit that is
asked for.  A conversation does go through one task: its digest is sequential.

From a state no two edits lead with the same letter, so the least string is
found by taking the least letter among the cheapest at every step.

Order is by turn (nulls first), role and text.  Null roles and texts count as one
space, so such a text is blank.  Rows without conversation form one.  A gap count
beyond a long is the largest long.  An empty table gives no rows; a conversation
of which no row is left has zeros, an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of back-pointers that a task keeps in memory.
SPILL = 16 << 20

SPACES = r"\x20\x09-\x0D"
LETTERS = "DIKR"
START, SYSTEM, USER, PAIR = range(4)
#: The state after a kept turn whose role begins with s, u, a or something else (None: not legal there).
KEPT = {START: (SYSTEM, USER, None, None), SYSTEM: (None, USER, None, None), USER: (None, None, PAIR, None), PAIR: (None, USER, None, None)}
#: The role that an inserted or renamed turn gets in a state, and the state after it.
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
#: Costs from each state at the end, and what is still inserted there.
ENDS, LAST = (0, 10, 5, 0), ("", "II", "I", "")
MOST = (1 << 63) - 1


class Program:
    """The dynamic program from the end; costs are kept less their minimum, so few vectors occur and steps are looked up."""

    def __init__(self):
        self.known = {}

    def step(self, costs: tuple, kind: int) -> tuple:
        """(costs before a turn of this class, amount taken out, byte of choices by state)."""
        found = self.known.get((costs, kind))
        if found is None:
            found = self.known[costs, kind] = self.computed(costs, kind)
        return found

    @staticmethod
    def computed(costs: tuple, kind: int) -> tuple:
        initial, fault = divmod(kind, 3)
        own = []
        for state in range(4):
            options = [(2 + costs[state], "D")]
            if fault < 2:
                extra = 5 if fault else 0
                if KEPT[state][initial] is not None:
                    options.append((extra + costs[KEPT[state][initial]], "K"))
                options.append((1 + extra + costs[GIVEN[state][1]], "R"))
            own.append(options)
        plain = [min(options)[0] for options in own]
        # an inserted turn and then one more never pays twice, so two rounds settle all states
        settled = list(plain)
        for _ in range(2):
            settled = [min(plain[s], 5 + settled[GIVEN[s][1]]) for s in range(4)]
        byte = 0
        for state in range(4):
            options = [*own[state], (5 + settled[GIVEN[state][1]], "I")]
            letter = min(x for cost, x in options if cost == settled[state])
            byte |= LETTERS.index(letter) << (2 * state)
        least = min(settled)
        return tuple(c - least for c in settled), least, byte


class Stack:
    """Bytes, last in first out, in a file beyond a limit."""

    def __init__(self, limit: int):
        self.file, self.tail, self.size = tempfile.SpooledTemporaryFile(max_size=limit), bytearray(), 0

    def push(self, byte: int) -> None:
        self.tail.append(byte)
        if len(self.tail) == 1 << 16:
            self.file.seek(self.size)
            self.file.write(self.tail)
            self.size += len(self.tail)
            self.tail = bytearray()

    def pop(self) -> int:
        if not self.tail:
            self.size -= 1 << 16
            self.file.seek(self.size)
            self.tail = bytearray(self.file.read(1 << 16))
        return self.tail.pop()

    def close(self) -> None:
        self.file.close()


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, here): rows damaged by a checksum of conversation and turn; dropped ones stay with ``here`` false."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in (conv, None, turn)])
    hit = F.crc32(name.cast("binary")) % 20
    body = F.coalesce(F.col(text), F.lit(" "))
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias("text"),
        (hit != 0).alias("here"), F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def arranged(rows: DataFrame, here: Column) -> DataFrame:
    """Every turn twice in one sorted stream per conversation: classes from the end, then texts from the start."""
    own = rows.select(
        F.col("conv").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), here.alias("here"),
    ).repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "here", "role", "text").orderBy("turn")) > 1
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("here"), "turn", "role", "text", "again"))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), 1).when(F.col("again"), 2)
        .when(~F.col("text").rlike(rf"[.!?][{SPACES}]*+\z"), 3).otherwise(0)
    )
    judged = own.withColumn("again", again).withColumn("place", place).withColumn("fault", fault).withColumn(
        "first", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    )
    nothing = F.lit(None).cast("string")
    both = F.array(
        F.struct(F.lit(0).alias("pass_"), (-F.col("place")).alias("at"), nothing.alias("turn"), nothing.alias("role"), nothing.alias("text")),
        F.struct(F.lit(1).alias("pass_"), F.col("place").alias("at"), F.col("turn").cast("string").alias("turn"), F.col("role"), F.col("text")),
    )
    return judged.select("conv", "here", "first", "fault", F.inline(both)).sortWithinPartitions("conv", "pass_", "at")


class Stream:
    """One conversation after the other; ``turns`` collects repaired turns, ``ended`` gives the summary."""

    def __init__(self, spill: int, with_turns: bool):
        self.program, self.spill, self.with_turns = Program(), spill, with_turns

    def begin(self, conv) -> None:
        self.conv, self.stack = conv, Stack(self.spill)
        self.costs, self.cost = ENDS, 0
        self.state, self.audit, self.counts, self.illegal, self.last = START, [], [0, 0, 0, 0], 0, None
        self.turns, self.digest, self.written = [], hashlib.sha256(), 0
        self.distinct, self.low, self.high = 0, None, None

    def behind(self, first: int, fault: int) -> None:
        """A class of the first pass, last turn first."""
        self.costs, least, byte = self.program.step(self.costs, 3 * first + (2, 2, 1)[fault - 1] if fault else 3 * first)
        self.cost += least
        self.stack.push(byte)

    def put(self, letter: str, role: str | None = None, text: str = "") -> None:
        self.audit.append(letter)
        if role is not None:
            self.digest.update(("\n" if self.written else "").encode() + f"{role}:{text}".encode())
            self.written += 1
        if self.with_turns:
            self.turns.append((self.conv, len(self.audit), letter, role, text if role is not None else None))

    def insert(self) -> None:
        role, self.state = GIVEN[self.state]
        self.put("I", role)

    def ahead(self, first: int, fault: int, turn: str | None, role: str, text: str) -> None:
        """A turn of the second pass, first turn first."""
        self.counts[fault] += 1
        self.illegal += self.last is not None and (self.last, first) not in ((0, 1), (1, 2), (2, 1))
        self.last = first
        if turn is not None and int(turn) != self.high:
            self.high = int(turn)
            self.low, self.distinct = self.high if self.low is None else self.low, self.distinct + 1
        byte = self.stack.pop()
        while (letter := LETTERS[byte >> (2 * self.state) & 3]) == "I":
            self.insert()
        if letter == "D":
            self.put("D")
        elif letter == "K":
            self.state = KEPT[self.state][first]
            self.put("K", role, text)
        else:
            role, self.state = GIVEN[self.state]
            self.put("R", role, text)

    def ended(self) -> tuple:
        for _ in LAST[self.state]:
            self.insert()
        self.stack.close()
        gaps = min(self.high - self.low + 1 - self.distinct, MOST) if self.distinct else 0
        _, blank, duplicate, truncated = self.counts
        return self.conv, gaps, blank, duplicate, truncated, self.illegal, self.cost + self.costs[START], "".join(self.audit), self.digest.hexdigest()


AUDIT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = ["conv", "place", "edit", "role", "text"]


def streamed(rows: DataFrame, here: Column | None, with_turns: bool, spill: int) -> DataFrame:
    kind = rows.schema["conv"].dataType

    def run(batches):
        stream, open_, out = Stream(spill, with_turns), False, []

        def shown():
            return pd.DataFrame(out, columns=TURNS if with_turns else AUDIT)

        for batch in batches:
            for conv, is_here, first, fault, pass_, turn, role, text in zip(*[batch[c].tolist() for c in ("conv", "here", "first", "fault", "pass_", "turn", "role", "text")]):
                if not open_ or conv != stream.conv:
                    if open_:
                        summary = stream.ended()
                        out += stream.turns if with_turns else [summary]
                    stream.begin(conv)
                    open_ = True
                if not is_here:
                    continue
                if pass_ == 0:
                    stream.behind(first, fault)
                else:
                    stream.ahead(first, fault, turn, role, text)
                    if with_turns and len(stream.turns) >= 4096:
                        out += stream.turns
                        stream.turns = []
                if len(out) >= 4096:
                    yield shown()
                    out = []
        if open_:
            summary = stream.ended()
            out += stream.turns if with_turns else [summary]
        if out:
            yield shown()

    schema = (
        "conv string, place bigint, edit string, role string, text string" if with_turns
        else "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    )
    made = arranged(rows, here if here is not None else F.lit(True)).mapInPandas(run, schema)
    return made.withColumn("conv", F.col("conv").cast(kind))


def audited(rows: DataFrame, here: Column | None = None, spill: int = SPILL) -> DataFrame:
    """One row per conversation of (conv, turn, role, text): faults, cost, edits and digest; ``here`` false only names a conversation."""
    return streamed(rows, here, False, spill)


def repaired(rows: DataFrame, here: Column | None = None, spill: int = SPILL) -> DataFrame:
    """(conv, place, edit, role, text): every edit in order; role and text are those of the repaired turn, null if deleted."""
    return streamed(rows, here, True, spill)
