"""Repair of conversations: the cheapest edits that make the roles alternate, found by shortest paths.

Rows of a conversation follow each other by turn (nulls first), rows of one turn by role, then by a hash of role and text. A
row's first fault counts: blank text, role and text seen before, or an end that is no end of a sentence. Edits keep a row (0),
give it the role user or assistant (2), delete it (3; blank rows and duplicates must go) or insert an empty one (2); a row
that stays though its end is missing adds 1. What is left must be nothing, or user and assistant in turn with one system row
at most before them.

The graph has a node for each place between rows and each last role. Costs are at most 3, so Dial's queue of four buckets
takes the place of a heap: from the ends back it gives every node its distance, and the arcs on which the distance falls by
just their cost are then walked from the start, the one with the least letter first.

A null conv_id is a conversation of its own, null turns come first, null roles and texts are one space. Roles count by their
first character, whatever follows. Repeated rows are duplicates. Other columns are not read. A conversation's rows meet in
one task as a stream: of a row 17 bytes and of each different text a hash are held there, never the texts, which are hashed
or written as they pass. That is the one limit: the SHA-256 of a conversation can only be computed in order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
#: the role that must follow each state, as the state that it leads to
AFTER = (USER, USER, ASSISTANT, USER)
BEFORE = tuple([q for q in range(4) if AFTER[q] == r] for r in range(4))
NAMES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
RETURN, DELETE, INSERT, OPEN = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}

#: A row's code: its role (0 for any other) and its fault.
SOUND, TRUNCATED, GOES = 0, 4, 8


def distances(codes: bytes) -> array:
    """The cost from every node to the nearest end: node 4 i + q stands before row i, after a row that led to state q."""
    n = len(codes)
    far = 4 * n + 8
    cost = array("i", [far]) * (4 * n + 4)
    buckets: list[list[int]] = [[4 * n + START, 4 * n + ASSISTANT], [], [], []]
    for node in buckets[0]:
        cost[node] = 0
    now, waiting = 0, 2

    def reach(node: int, d: int) -> int:
        if d < cost[node]:
            cost[node] = d
            buckets[d & 3].append(node)
            return 1
        return 0

    while waiting:
        bucket = buckets[now & 3]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if cost[node] != now:  # reached again, for less
                continue
            i, r = node >> 2, node & 3
            for q in BEFORE[r]:
                waiting += reach(4 * i + q, now + INSERT)
            if not i:
                continue
            code = codes[i - 1]
            waiting += reach(node - 4, now + DELETE)
            if code & GOES:
                continue
            stays = now + (OPEN if code & TRUNCATED else 0)
            if code & 3 == r:
                for q in (START,) if r == SYSTEM else BEFORE[r]:
                    waiting += reach(4 * i - 4 + q, stays)
            for q in BEFORE[r]:
                waiting += reach(4 * i - 4 + q, stays + RETURN)
        now += 1
    return cost


def steps(codes: bytes, cost: array) -> Iterator[str]:
    """The letters of the cheapest edits, the ASCII-least of them: tight arcs from the start, D before I before K before R."""
    i, q, n = 0, START, len(codes)
    while i < n or q not in (START, ASSISTANT):
        here, after = cost[4 * i + q], AFTER[q]
        if i < n:
            code = codes[i]
            role, open_ = code & 3, OPEN if code & TRUNCATED else 0
            keeps = not code & GOES and (role == after or (role == SYSTEM and q == START))
            to = SYSTEM if role == SYSTEM else after
        if i < n and here == DELETE + cost[4 * i + 4 + q]:
            i += 1
            yield "D"
        elif here == INSERT + cost[4 * i + after]:
            q = after
            yield "I"
        elif i < n and keeps and here == open_ + cost[4 * i + 4 + to]:
            i, q = i + 1, to
            yield "K"
        else:
            i, q = i + 1, after
            yield "R"


class Conversation:
    """What is kept of a conversation's rows as they pass."""

    def __init__(self, name) -> None:
        self.name, self.codes, self.seen, self.last = name, bytearray(), set(), None
        self.first = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, mark: bytes, blank: bool, open_: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last, code = initial, LETTERS.get(initial, 0)
        if blank:
            self.blank += 1
            code |= GOES
        elif mark in self.seen:
            self.duplicate += 1
            code |= GOES
        else:
            self.seen.add(mark)
            if open_:
                self.truncated += 1
                code |= TRUNCATED
        self.codes.append(code)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.turn - self.first + 1 - self.turns, (1 << 63) - 1)
        self.seen.clear()
        cost = distances(self.codes)
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost[START], "".join(steps(self.codes, cost))


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with a 16-byte hash of role and text; nulls are one space. gone says of a row that it only names its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    key = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return named.withColumn("mark", F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "mark")


def audits(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps between turns, rows by first fault, roles out of turn, cost and letters of the edits.

    Of the texts only hashes and faults are shuffled. Rows of which gone is true count for nothing but their conv_id; a
    conversation without other rows has zeros and no edits.
    """
    full, sentence = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    slim = marked(rows).select(
        "conv_id", "turn", "role", "mark", "gone", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(full)).alias("blank"),
        (~F.col("text").rlike(sentence)).alias("open"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(it):
        held, done = None, []
        for b in it:
            key = b.schema.field(0)
            names, turns, _, marks, gone, initials, blank, ends = (c.to_pylist() for c in b.columns)
            for k, name in enumerate(names):
                if held is None or held.name != name:
                    if held is not None:
                        done.append(held.row())
                    held = Conversation(name)
                if not gone[k]:
                    held.add(turns[k], initials[k], marks[k], blank[k], ends[k])
            yield table(key, done)
            done = []
        if held is not None:
            yield table(key, [held.row()])

    def table(key, found):
        kinds = [key.type, *[pa.int64()] * 6, pa.string()]
        columns = list(zip(*found)) or [()] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(COLUMNS))

    longs = ", ".join(f"{c} long" for c in COLUMNS[1:-1])
    return in_order(slim).mapInArrow(run, f"conv_id {kind}, {longs}, audit string")


def after_audits(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows in order, before those of each conversation its audit."""
    heads = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("mark", "binary"))), *COLUMNS[1:])
    tails = marked(rows).where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "mark", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in COLUMNS[1:]))
    return in_order(heads.unionByName(tails), "kind").drop("mark")


class Editor:
    """Applies a conversation's audit to its rows as they pass."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, None, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, AFTER[self.state]
            yield "I", None, NAMES[self.state], ""

    def edit(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) of the rows that take this row's place."""
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "D":
            return
        keeps_system = letter == "K" and role[:1] == "s"
        self.state = SYSTEM if keeps_system else AFTER[self.state]
        yield letter, turn, role if letter == "K" else NAMES[self.state], text


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, step, edit, turn, role, text): what the edits leave, step by step from 0; inserted rows have no turn."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(it):
        editor, name, step, out = None, None, 0, []

        def put(found):
            nonlocal step
            for edit, turn, role, text in found:
                out.append((name, step, edit, turn, role, text))
                step += 1

        def table(key):
            kinds = [key.type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "step", "edit", "turn", "role", "text"])

        for b in it:
            key = b.schema.field(0)
            for conv, first, turn, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "audit"))):
                if first == 0:
                    if editor:
                        put(editor.inserts())
                    editor, name, step = Editor(audit), conv, 0
                else:
                    put(editor.edit(turn, role, text))
            yield table(key)
        if editor:
            put(editor.inserts())
            yield table(key)

    return after_audits(rows, audited).mapInArrow(run, f"conv_id {kind}, step long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Audits with the sha256 of the repaired rows, as role:text joined by newlines: hashed while the rows pass."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(it):
        head = editor = digest = None
        done, some = [], False

        def put(found):
            nonlocal some
            for _, _, role, text in found:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        def close():
            put(editor.inserts())
            done.append((*head, digest.hexdigest()))

        def table(key):
            kinds = [key.type, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = list(zip(*done)) or [()] * len(kinds)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*COLUMNS, "repaired_sha256"])

        for b in it:
            key = b.schema.field(0)
            heads = zip(*(b.column(c).to_pylist() for c in COLUMNS))
            for found, first, turn, role, text in zip(heads, *(b.column(c).to_pylist() for c in ("kind", "turn", "role", "text"))):
                if first == 0:
                    if editor:
                        close()
                    head, editor, digest, some = found, Editor(found[-1]), hashlib.sha256(), False
                else:
                    put(editor.edit(turn, role, text))
            yield table(key)
        if editor:
            close()
            yield table(key)

    longs = ", ".join(f"{c} long" for c in COLUMNS[1:-1])
    return after_audits(rows, audited).mapInArrow(run, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of conv_id:turn, modulo 20: 0 drops a row (gone), 1 empties its text, 2 takes
    out its ends of sentences, 3 repeats it, 4 sets the role user. Nulls are one space; turns stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")
