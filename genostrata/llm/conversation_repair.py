"""Cheapest repair of the turn structure of conversations.

Turns are kept (0), given another role (2), deleted (3) or inserted without text (2), so that the roles
of a conversation are an optional system turn and then pairs of user and assistant, or nothing. Blank
and duplicate turns have to go; a truncated turn that stays costs 1.

The least costs of what follows, for each of the four states that a conversation can be in, are a
vector; less their minimum, only a few such vectors occur. So, as in the method of the Four Russians,
tables hold for each of these vectors and each block of BLOCK turns, by kind, the vector before the
block and what it adds. A conversation is gone through from its end, one lookup a block. To trace, the
blocks are expanded once more from their own right ends, and in each turn the first letter of
D, I, K, R that is on a cheapest way is taken, which gives the least of all cheapest edit strings.

Turns are brought together by conversation in one shuffle and sorted there. A task holds a byte for
each turn of one conversation, as the edits of a conversation, one value, have to be held anyway, and
its texts up to HELD bytes; a conversation of more text is read a second time, sorted, with its edits
in front, so no group is ever held as a whole.

Defined results: turns are in order of turn, null first, then role, then text; a null role or text
counts as one space; rows of a null conv_id are one conversation; repeated rows are duplicate turns;
rows whose `present` is false tell only that there is such a conversation, and without other rows its
numbers are 0 and its edits empty; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, in_batches, small_or_shuffled

SPACE = "\x20\t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Turns of a block of the tables, and bytes of text that are held of a conversation.
BLOCK, HELD = 4, 8 << 20

#: States: nothing yet, after system, after user, after assistant; where an inserted turn leads.
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
#: Where a kept turn leads, by state and initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "user", 3: "assistant"}
#: Kinds of turns: one that has to go; by initial and whether it is truncated; none (filling up a block).
INITIALS = ("s", "u", "a", "")
GO, NONE = 0, 9
KINDS = 10


def kind_of(initial: str, fault: int) -> int:
    return GO if fault in (1, 2) else 1 + 2 * (INITIALS.index(initial) if initial in INITIALS else 3) + (fault == 3)


def inserted(h: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted first."""
    for _ in range(3):
        h = [min(c, INSERT + h[NEXT[s]]) for s, c in enumerate(h)]
    return tuple(h)


def before(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs before a turn from those after it."""
    if kind == NONE:
        return after
    h = [DELETE + c for c in after]
    if kind != GO:
        initial, cut = INITIALS[(kind - 1) // 2], CUT_OFF * ((kind - 1) % 2)
        for s in range(4):
            h[s] = min(h[s], REROLE + cut + after[NEXT[s]])
            if (s, initial) in KEPT:
                h[s] = min(h[s], KEEP + cut + after[KEPT[s, initial]])
    return inserted(h)


def move(after: tuple[int, ...], kind: int, state: int) -> tuple[str, int]:
    """The least letters of a cheapest way past a turn, and the state after it."""
    out, h = "", before(after, kind)
    if kind == NONE:
        return out, state
    cut = CUT_OFF * ((kind - 1) % 2)
    while True:
        if DELETE + after[state] == h[state]:
            return out + "D", state
        if INSERT + h[NEXT[state]] == h[state]:
            out, state = out + "I", NEXT[state]
            continue
        to = KEPT.get((state, INITIALS[(kind - 1) // 2]))
        if to is not None and KEEP + cut + after[to] == h[state]:
            return out + "K", to
        return out + "R", NEXT[state]


class Tables:
    """Vectors of costs less their minimum, numbered, the first that of the end; what each kind of turn
    and each block of turns makes of them; and the moves of the trace."""

    def __init__(self, block: int = BLOCK) -> None:
        end = inserted([0 if s in ENDS else 1 << 20 for s in range(4)])
        self.vectors, number, self.block = [end], {end: 0}, block
        step: list[list[tuple[int, int]]] = []
        for v in self.vectors:  # grows until no kind of turn gives a new one
            row = []
            for kind in range(KINDS):
                h = before(v, kind)
                low = min(h)
                h = tuple(c - low for c in h)
                if h not in number:
                    number[h] = len(self.vectors)
                    self.vectors.append(h)
                row.append((number[h], low))
            step.append(row)
        self.to, self.low = (np.array([[x[i] for x in row] for row in step], np.int32) for i in (0, 1))
        codes = np.arange(KINDS**block)
        at, added = np.tile(np.arange(len(self.vectors))[:, None], len(codes)), np.zeros((len(self.vectors), len(codes)), np.int32)
        for place in range(block):  # from the right
            kind = codes // KINDS**place % KINDS
            added += self.low[at, kind]
            at = self.to[at, kind]
        self.block_to, self.block_low = at, added
        self.scale = KINDS ** np.arange(block - 1, -1, -1)
        self.moves = {(i, k, s): move(v, k, s) for (i, v), k, s in product(enumerate(self.vectors), range(KINDS), range(4))}

    def solved(self, kinds: bytes) -> tuple[int, str]:
        """(cost, edits) of turns of these kinds."""
        n = -(-len(kinds) // self.block)
        x = np.frombuffer(kinds + bytes([NONE]) * (n * self.block - len(kinds)), np.uint8).reshape(n, self.block)
        right, at, cost = np.zeros(n, np.int32), 0, 0
        for b, code in zip(range(n - 1, -1, -1), (x @ self.scale)[::-1].tolist()):
            right[b] = at
            cost += int(self.block_low[at, code])
            at = int(self.block_to[at, code])
        cost += self.vectors[at][0]
        state, out = 0, []
        for turns, at in zip(x.tolist(), right.tolist()):
            inner = [at]
            for kind in turns[:0:-1]:
                inner.append(int(self.to[inner[-1], kind]))
            for kind, at in zip(turns, reversed(inner)):
                letters, state = self.moves[at, kind, state]
                out.append(letters)
        while state not in ENDS:
            out.append("I")
            state = NEXT[state]
        return cost, "".join(out)


def rewriting(edits: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, from the turns in order, one at a time."""
    state = 0
    for e in edits:
        role, text = next(turns) if e != "I" else ("", "")
        if e == "D":
            continue
        if e == "K":
            state = KEPT[state, role[:1]]
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield e, role, text


class Digest:
    """SHA-256 of role:text lines."""

    def __init__(self) -> None:
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def hex(self) -> str:
        return self.hash.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ORDER = ("turn", "role", "text")


def in_order(*first: str) -> list[Column]:
    return [*(F.col(c) for c in first), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def told_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """(conv_id, turn, role, text, present) with one space for null roles and texts."""
    there = F.lit(True) if present is None else F.coalesce(F.col(f"`{present}`"), F.lit(False))
    return rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(f"`{role}`", F.lit(" ")).alias("role"), F.coalesce(f"`{text}`", F.lit(" ")).alias("text"), there.alias("present")
    )


def faulty(turns: DataFrame) -> DataFrame:
    """The turns of each conversation together and in order, with `fault`: 1 blank, 2 duplicate, 3
    truncated, 0 none. One shuffle; what is a duplicate is found by a sort within it."""
    near = turns.repartition("conv_id")
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(ended == "", 1).when(again, 2).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return near.withColumn("fault", fault).sortWithinPartitions(*in_order("conv_id"), "fault")  # of equal turns the first is no duplicate


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows, one at a time) of rows that stand together; a conversation not read to its end is skipped."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    head = next(rows, None)
    while head is not None:
        key, done = head[0], False

        def own() -> Iterator[tuple]:
            nonlocal head, done
            while head is not None and head[0] == key:
                yield head[1:]
                head = next(rows, None)
            done = True

        one = own()
        yield key, one
        for _ in one:
            pass


def summary(tables: Tables, rows: Iterator[tuple], held: int) -> tuple[list[int], str, str | None]:
    """(COUNTS, edits, digest) of one conversation; no digest if it has more text than is held."""
    kinds, texts, size = bytearray(), [], 0
    faults, illegal, last = [0] * 4, 0, None
    low = high = None
    distinct = 0
    for turn, role, text, present, fault in rows:
        if not present:
            continue
        faults[fault] += 1
        if turn is not None and turn != high:  # in order
            low, high, distinct = turn if low is None else low, turn, distinct + 1
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
        kinds.append(kind_of(last, fault))
        size += len(text) + len(role)
        if size <= held:
            texts.append((role, text))
        else:
            texts.clear()
    cost, edits = tables.solved(bytes(kinds))
    digest = None
    if size <= held:
        d = Digest()
        for _, role, text in rewriting(edits, iter(texts)):
            d.add(role, text)
        digest = d.hex()
    gaps = high - low + 1 - distinct if distinct else 0
    return [gaps, *faults[1:], illegal, cost], edits, digest


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, held: int = HELD
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, edits, digest): one row for each
    conversation; digest is that of the lines role:text after repair."""
    turns = told_turns(rows, conv_id, turn, role, text, present)
    schema = T.StructType([turns.schema["conv_id"], *(T.StructField(c, T.LongType(), False) for c in COUNTS), T.StructField("edits", T.StringType(), False), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out = Tables(), []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            kinds = [id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

        id_type, size = None, 0

        def seen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in source:
                id_type = b.schema.field(0).type
                yield b

        for key, own in conversations(seen(batches)):
            counts, edits, digest = summary(tables, own, held)
            out.append((key, *counts, edits, digest))
            size += len(edits)
            if len(out) >= 5000 or size > 1 << 20:
                yield batch()
                out.clear()
                size = 0
        if out:
            yield batch()

    found = in_batches(faulty(turns).select("conv_id", "turn", "role", "text", "present", "fault"), run, schema)
    found = durable(found)
    long = found.where("digest IS NULL")
    if not long.limit(1).count():
        return found

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b_type, key, lines in rewritten_runs(batches):
            d = Digest()
            for _, role, text in lines:
                d.add(role, text)
            yield pa.RecordBatch.from_arrays([pa.array([key], b_type), pa.array([d.hex()])], names=["conv_id", "digest"])

    again = in_batches(with_edits(turns, long), digests, T.StructType([turns.schema["conv_id"], T.StructField("digest", T.StringType(), False)]))
    same = F.col("l.conv_id").eqNullSafe(F.col("a.conv_id"))
    return found.where("digest IS NOT NULL").unionByName(long.drop("digest").alias("l").join(again.alias("a"), same).select("l.*", "a.digest"))


def with_edits(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """The turns of the repaired conversations, each conversation's edits in front of them."""
    ids = repaired.select(F.col("conv_id").alias("_id"))
    some = turns.where("present").join(small_or_shuffled(ids), F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    front = repaired.select("conv_id", F.lit(0).alias("at"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("edits").alias("text"))
    rows = front.unionByName(some.select("conv_id", F.lit(1).alias("at"), "turn", "role", "text"))
    return rows.repartition("conv_id").sortWithinPartitions(*in_order("conv_id", "at"))


def rewritten_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, object, Iterator[tuple[str, str, str]]]]:
    kind = None

    def seen() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    for key, own in conversations(seen()):
        edits = next(own)[3]
        yield kind, key, rewriting(edits, ((role, text) for _, _, role, text in own))


def rewritten(rows: DataFrame, repaired: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the conversations after repair, from the rows and
    what `repair` gave for them."""
    turns = told_turns(rows, conv_id, turn, role, text, present)
    schema = T.StructType([turns.schema["conv_id"]]).add("place", T.LongType(), False).add("edit", T.StringType(), False).add("role", T.StringType(), False).add("text", T.StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, key, lines in rewritten_runs(batches):
            out: list[tuple[int, str, str, str]] = []
            size = 0
            for i, line in enumerate(lines):
                out.append((i, *line))
                size += len(line[2])
                if len(out) >= 5000 or size > 1 << 20:
                    yield made(kind, key, out)
                    out, size = [], 0
            if out:
                yield made(kind, key, out)

    def made(kind: pa.DataType, key: object, out: list[tuple[int, str, str, str]]) -> pa.RecordBatch:
        columns = zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([key] * len(out), kind), *(pa.array(c, t) for c, t in columns)], names=schema.names)

    return in_batches(with_edits(turns, repaired.select("conv_id", "edits")), run, schema)
