"""Repair of damaged conversations by a Viterbi search whose edits are handed out as soon as they are certain.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its rows go one by one through four states (nothing yet,
system, user, assistant last); for each state the cheapest edits so far are a path in a tree of backpointers. Nodes count
who refers to them: what no path needs any more goes, and once all paths share an ancestor, the edits up to there are
final and leave the tree. Memory holds only the unresolved ends, however long a conversation is. Equal costs are decided
by comparing the whole unresolved ends as text.

Edits: (K)eep 0, (R)erole to user or assistant 3, (D)elete 4, (I)nsert an empty user or assistant row 3. Blank and
repeated rows must be deleted; a truncated row that stays costs 3 more.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
START = "0"
NEXT = {(START, "s"): "s", (START, "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
FINAL = (START, "a")
#: What a path in the first state must cost more than one in the second to be hopeless: the second can do all that the
#: first can, for so much more at most (delete a kept system row; nothing; insert a row).
HOPELESS = {(START, "a"): 4, ("s", "a"): 0, ("u", "a"): 3, ("a", "u"): 3}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\v\f\r"
BATCH_ROWS = 4096


class _Node:
    """``times`` equal edits that lead to ``state``."""

    __slots__ = ("letter", "times", "state", "parent", "refs", "depth")

    def __init__(self, letter: str, times: int, state: str, parent: _Node | None):
        self.letter, self.times, self.state, self.parent, self.refs = letter, times, state, parent, 0
        self.depth = times + (parent.depth if parent else 0)
        if parent:
            parent.refs += 1


def _release(node: _Node | None) -> None:
    while node is not None and not node.refs:
        node, gone = node.parent, node
        gone.parent = None
        if node is not None:
            node.refs -= 1


def _smaller(a: _Node, b: _Node) -> bool:
    """Whether the edits of ``a`` come before those of ``b`` as text, by their ends after the common ancestor."""
    ends: tuple[list[str], list[str]] = ([], [])
    while a is not b:
        if a.depth >= b.depth:
            ends[0].append(a.letter * a.times)
            a = a.parent
        else:
            ends[1].append(b.letter * b.times)
            b = b.parent
    return "".join(reversed(ends[0])) < "".join(reversed(ends[1]))


class Repair:
    """One conversation. ``add`` and ``finish`` yield the edits that are certain: (letter, role, text) in order.

    Of a deleted row, role and text are what they were. ``cost`` is that of the whole repair after ``finish``; ``most``
    is the largest number of rows that waited at once.
    """

    def __init__(self):
        self.anchor = _Node("", 0, START, None)
        self.anchor.refs = 1
        self.paths: dict[str, tuple[int, _Node]] = {START: (0, self.anchor)}
        self.waiting: deque[tuple[str, str, int]] = deque()
        self.cost = self.most = 0
        self._inserts()

    def _offer(self, paths: dict, state: str, cost: int, letter: str, times: int, parent: _Node) -> None:
        old = paths.get(state)
        if old and old[0] < cost:
            return
        node = _Node(letter, times, state, parent)
        if old and old[0] == cost and not _smaller(node, old[1]):
            _release(node)
            return
        node.refs += 1
        paths[state] = (cost, node)
        if old:
            old[1].refs -= 1
            _release(old[1])

    def _inserts(self) -> None:
        for states, to in (((START, "s", "a"), "u"), (("u",), "a")):
            for state in states:
                if state in self.paths:
                    cost, node = self.paths[state]
                    self._offer(self.paths, to, cost + COST[INSERT], INSERT, 1, node)
        for (weak, strong), more in HOPELESS.items():
            if weak in self.paths and strong in self.paths and self.paths[weak][0] > self.paths[strong][0] + more:
                node = self.paths.pop(weak)[1]
                node.refs -= 1
                _release(node)

    def add(self, role: str, text: str, delete: bool, truncated: bool = False, times: int = 1) -> Iterator[tuple[str, str, str]]:
        """The next row; ``times`` equal rows at once if they must be deleted."""
        new: dict[str, tuple[int, _Node]] = {}
        for state, (cost, node) in self.paths.items():
            self._offer(new, state, cost + COST[DELETE] * times, DELETE, times, node)
            if not delete:
                cost += TRUNCATED_COST * truncated
                if to := NEXT.get((state, role[:1])):
                    self._offer(new, to, cost + COST[KEEP], KEEP, 1, node)
                for initial in ROLES:
                    if to := NEXT.get((state, initial)):
                        self._offer(new, to, cost + COST[REROLE], REROLE, 1, node)
        for _, node in self.paths.values():
            node.refs -= 1
            _release(node)
        self.paths = new
        self.waiting.append((role, text, times))
        self.most = max(self.most, len(self.waiting))
        self._inserts()
        yield from self._certain()

    def _certain(self) -> Iterator[tuple[str, str, str]]:
        """Edits between the anchor and the lowest ancestor that all paths share; that one becomes the anchor."""
        if self.anchor.refs > 1:
            return
        path, node = [], next(iter(self.paths.values()))[1]
        while node is not self.anchor:
            path.append(node)
            node = node.parent
        while path and self.anchor.refs == 1:
            node = path.pop()
            self.anchor, node.parent = node, None
            yield from self._edit(node)

    def _edit(self, node: _Node) -> Iterator[tuple[str, str, str]]:
        if node.letter == INSERT:
            yield INSERT, ROLES[node.state], ""
            return
        role, text, times = self.waiting.popleft()
        role = ROLES[node.state] if node.letter == REROLE else role
        for _ in range(times):
            yield node.letter, role, text

    def finish(self) -> Iterator[tuple[str, str, str]]:
        best = None
        for state in FINAL:
            if state in self.paths:
                cost, node = self.paths[state]
                if best is None or cost < best[0] or cost == best[0] and _smaller(node, best[1]):
                    best = cost, node
        self.cost, node = best
        path = []
        while node is not self.anchor:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            yield from self._edit(node)


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """Rows (conv, turn, role, text, n, here, fresh) of each conversation in one partition, in order.

    Equal rows are counted before they are shuffled. ``fresh``: no earlier row has this role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), present.alias("here"))
    rows = rows.groupBy("conv", "turn", "role", "text", "here").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv", "here", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("fresh", F.row_number().over(earlier) == 1)
    return rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield from batch.slice(at, BATCH_ROWS).to_pylist()


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_truncated(text: str) -> bool:
    """Whether the last character that isn't space is none of ``.!?``; false for blank text."""
    end = text.rstrip(SPACE)
    return bool(end) and end[-1] not in ".!?"


class _Faults:
    """Counts over the rows of a conversation, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.before = None

    def see(self, turn: int | None, role: str, times: int, blank: bool, duplicates: int, truncated: bool) -> None:
        self.blank += blank * times
        self.duplicate += duplicates
        self.truncated += truncated
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += times - 1  # a row beside an equal one
        self.before = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn = turn
            self.least = turn if self.least is None else self.least

    @property
    def gaps(self) -> int:
        return 0 if self.turn is None else self.turn - self.least + 1 - self.turns


def _steps(row: dict, repair: Repair, faults: _Faults) -> Iterator[tuple[str, str, str]]:
    """Edits that become certain with a row and the rows equal to it."""
    role, text, n = row["role"], row["text"], row["n"]
    blank = is_blank(text)
    first = row["fresh"] and not blank  # all others must go
    truncated = first and is_truncated(text)
    faults.see(row["turn"], role, n, blank, 0 if blank else n - first, truncated)
    if first:
        yield from repair.add(role, text, False, truncated)
    if n > first:
        yield from repair.add(role, text, True, times=n - first)


def repair_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (``conv``, position, edit, role, text) of all edits of each conversation, position counting from 0.

    Rows are taken by turn (nulls first), then role and text; null roles and texts are one space. Repaired conversations
    are the rows whose edit isn't ``D``. A null conversation id is a conversation. Other columns aren't read. A
    conversation is searched by one task, as its rows come; only unresolved rows are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in groupby(_rows(batches), lambda r: r["conv"]):
            repair, at = Repair(), 0
            for edits in chain((_steps(row, repair, _Faults()) for row in rows), (repair.finish() for _ in (0,))):
                for letter, new_role, new_text in edits:
                    out.append((key, at, letter, new_role, new_text))
                    at += 1
                    if len(out) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)
                        out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    names = ["conv", "position", "edit", "role", "text"]
    field = T.StructField("conv", turns.schema[conv].dataType)
    schema = T.StructType([field]).add("position", "long").add("edit", "string").add("role", "string").add("text", "string")
    arrow = to_arrow_schema(schema)
    found = _ordered(turns, conv, turn, role, text, F.lit(True)).mapInArrow(run, schema)
    return found.withColumnRenamed("conv", conv)


def audit_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """One row per conversation: faults, cost and edits of its repair, and the SHA-256 of the repaired rows.

    Columns ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits), repaired_sha256
    (of ``role:text`` of the rows left, joined by newlines). Rows where ``present`` is false only make their conversation
    appear; one without other rows has zeros, no edits and the hash of nothing. For rows, see `repair_turns`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for key, rows in groupby(_rows(batches), lambda r: r["conv"]):
            repair, faults, digest, audit, left = Repair(), _Faults(), hashlib.sha256(), [], 0
            there = (row for row in rows if row["here"])
            for edits in chain((_steps(row, repair, faults) for row in there), (repair.finish() for _ in (0,))):
                for letter, new_role, new_text in edits:
                    audit.append(letter)
                    if letter != DELETE:
                        digest.update(("\n" * (left > 0) + f"{new_role}:{new_text}").encode())
                        left += 1
            counts = [faults.gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, repair.cost]
            out.append(dict(zip(names, [key, *counts, "".join(audit), digest.hexdigest()], strict=True)))
            if len(out) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = T.StructType([T.StructField("conv", turns.schema[conv].dataType)])
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    names, arrow = schema.names, to_arrow_schema(schema)
    here = F.lit(True) if present is None else present
    return _ordered(turns, conv, turn, role, text, here).mapInArrow(run, schema).withColumnRenamed("conv", conv)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv, turn, role, text and ``present``: rows damaged by crc32(``conv:turn``) % 20, nulls being one space.

    0: not present; 1: text empty; 2: text without ``.!?``; 3: the row twice; 4: role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv), space(turn)).cast("binary")) % 20
    rows = turns.select(conv, turn, space(role).alias("_role"), space(text).alias("_text"), kind.alias("_kind"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    new_text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    new_role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role"))
    rows = rows.select(conv, turn, new_role.alias(role), new_text.alias(text), (F.col("_kind") != 0).alias("present"), copies.alias("_copy"))
    return rows.drop("_copy")
