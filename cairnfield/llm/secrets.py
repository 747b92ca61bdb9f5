"""Secret scan by one deterministic automaton that is combined from all rules.

Rules are regular expressions over bytes. They are parsed into one nondeterministic automaton behind "anything", made
deterministic by subset construction, minimised, and stored as transition arrays over byte classes. The expressions are
reversed, and one pass over the bytes of a text, from its end, tells where matches of which rules begin. Most texts have
no such place. From a place a combined forward automaton takes the longest match, and the rule goes on behind it, so that
the time is in proportion to the text, however often a rule nearly matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.words import text_buffer
from cairnfield.llm.work import refuse_clashes


@dataclass(frozen=True)
class Rule:
    """``pattern``: literals, [classes], (groups|alternatives), ?, *, + and {n,}; ``least``: shortest valid match.

    A match isn't valid either if the characters from the last one of its shortest form on are fewer than
    ``least_tail``: what stands for the value behind a name. A rule that can go on for long after a match without
    matching again reads that part once more for its next match; none of ``RULES`` can.
    """

    kind: str
    pattern: str
    least: int = 0
    least_tail: int = 0
    any_case: str = ""  # a prefix pattern in which letters stand for both cases


_VALUE = "[A-Za-z0-9+/_.=-]"
BASE_RULES = (
    Rule("assign", "[\"']?[ ]*[:=][ ]*[\"']?" + _VALUE + "+", least_tail=6, any_case="(password|passwd|secret|token|api_?key)"),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


# --- expressions to a nondeterministic automaton ---------------------------------------------------------------------


class Nfa:
    """States are numbers; ``steps[s]`` has (set of bytes, next state), ``free[s]`` the states reached by nothing."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, pattern: str, start: int, any_case: bool = False) -> int:
        """Append ``pattern`` after ``start``; its last state."""
        end, at = self._choice(pattern, 0, start, any_case)
        if at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} from {at}")
        return end

    def _choice(self, p: str, at: int, start: int, any_case: bool) -> tuple[int, int]:
        out = self.state()
        while True:
            head = self.state()
            self.free[start].append(head)
            end, at = self._sequence(p, at, head, any_case)
            self.free[end].append(out)
            if at < len(p) and p[at] == "|":
                at += 1
                continue
            return out, at

    def _sequence(self, p: str, at: int, here: int, any_case: bool) -> tuple[int, int]:
        while at < len(p) and p[at] not in "|)":
            begin = at
            after, at = self._atom(p, at, here, any_case)
            if at < len(p) and p[at] in "?*+":
                if p[at] in "*+":
                    self.free[after].append(here)
                if p[at] in "?*":
                    self.free[here].append(after)
                at += 1
            elif bounds := re.compile(r"\{(\d+),\}").match(p, at):
                unit = p[begin:at]
                for _ in range(int(bounds[1]) - 1):
                    last, (after, _) = after, self._atom(unit, 0, after, any_case)
                self.free[after].append(last)
                at = bounds.end()
            joint = self.state()
            self.free[after].append(joint)
            here = joint
        return here, at

    def _atom(self, p: str, at: int, here: int, any_case: bool) -> tuple[int, int]:
        if p[at] == "(":
            head = self.state()
            self.free[here].append(head)
            end, at = self._choice(p, at + 1, head, any_case)
            return end, at + 1
        if p[at] == "[":
            close = p.index("]", at + 1)
            codes = _class(p[at + 1 : close])
            at = close + 1
        else:
            codes = {ord(p[at])}
            at += 1
        if any_case:
            codes |= {ord(c) for b in codes for c in (chr(b).lower(), chr(b).upper()) if chr(b).isalpha()}
        end = self.state()
        self.steps[here].append((frozenset(codes), end))
        return end, at

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)


def _class(body: str) -> set[int]:
    codes, i = set(), 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            codes |= set(range(ord(body[i]), ord(body[i + 2]) + 1))
            i += 3
        else:
            codes.add(ord(body[i]))
            i += 1
    return codes


# --- the deterministic automaton ---------------------------------------------------------------------------------------


@dataclass
class Dfa:
    """From state s by byte b to ``step[s * width + classes[b]]``; ``accepts[s]`` has a bit for each rule that ends."""

    step: np.ndarray
    classes: np.ndarray
    width: int
    accepts: np.ndarray
    start: int


def _byte_classes(sets: Sequence[frozenset[int]]) -> np.ndarray:
    groups: dict[tuple[bool, ...], int] = {}
    return np.array([groups.setdefault(tuple(b in s for s in sets), len(groups)) for b in range(256)])


def compile_rules(rules: Sequence[Rule], backward: bool = False) -> Dfa:
    """Minimal automaton of all rules: from a first byte on, where matches end.

    ``backward``: of the reversed rules from any byte on, where matches begin if a text is read from its end.
    """
    nfa, heads, ends = Nfa(), {}, {}
    start = nfa.state()
    for bit, rule in enumerate(rules):
        head = nfa.state()
        nfa.free[start].append(head)
        heads[head] = 1 << bit
        ends[nfa.add(rule.pattern, nfa.add(rule.any_case, head, True) if rule.any_case else head)] = 1 << bit
    if not backward:
        return _deterministic(nfa, start, ends)
    turned = Nfa()
    for _ in nfa.steps:
        turned.state()
    for s, (steps, free) in enumerate(zip(nfa.steps, nfa.free, strict=True)):
        for codes, t in steps:
            turned.steps[t].append((codes, s))
        for t in free:
            turned.free[t].append(s)
    root = turned.state()
    turned.free[root] += list(ends)
    turned.steps[root].append((frozenset(range(256)), root))
    return _deterministic(turned, root, heads)


def _deterministic(nfa: Nfa, start: int, marks: dict[int, int]) -> Dfa:
    """Subset construction and minimisation; ``marks`` has the bits of the states that accept."""
    classes = _byte_classes(sorted({codes for steps in nfa.steps for codes, _ in steps}, key=sorted))
    width = int(classes.max()) + 1
    sample = [int(np.argmax(classes == c)) for c in range(width)]
    first = nfa.closure(frozenset([start]))
    number, order, table = {first: 0}, [first], []
    for subset in order:  # grows while subsets are found
        row = []
        moves = [step for s in subset for step in nfa.steps[s]]
        for byte in sample:
            target = nfa.closure(frozenset(t for codes, t in moves if byte in codes))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    accepts = np.array([sum(bit for s, bit in marks.items() if s in subset) for subset in order])
    table = np.array(table)
    # Minimisation: part states by what they accept, then by where they go, until nothing parts any more.
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        rows = np.column_stack([part, part[table]])
        finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    keep = np.unique(part, return_index=True)[1]
    return Dfa(part[table][keep].reshape(-1).astype(np.int64), classes, width, accepts[keep], int(part[0]))


class Scanner:
    """Finds all valid matches of the rules in one text."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = list(rules)
        back = compile_rules(rules, backward=True)
        # States that accept come last, so that one comparison tells them apart; steps lead to row starts.
        order = np.argsort(back.accepts != 0, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        table = rank[back.step.reshape(-1, back.width)[order]] * back.width
        self.step = table.reshape(-1).tolist()
        self.first_accept = int((back.accepts == 0).sum()) * back.width
        self.accepts = {int(i) * back.width: int(a) for i, a in enumerate(back.accepts[order]) if a}
        self.classes = bytes(back.classes.astype(np.uint8))
        self.start = int(rank[back.start]) * back.width

        fore = compile_rules(rules)
        table = fore.step.reshape(-1, fore.width)
        live = np.zeros(len(table), np.int64)  # bits of the rules that can still end further on
        while True:
            more = np.bitwise_or.reduce((fore.accepts | live)[table], axis=1)
            if (more == live).all():
                break
            live = more
        self.fore_step = (fore.step * fore.width).tolist()
        self.fore_classes = fore.classes.tolist()
        self.fore_start = fore.start * fore.width
        self.ends = {i * fore.width: int(a) for i, a in enumerate(fore.accepts)}
        self.live = {i * fore.width: int(a) for i, a in enumerate(live)}

    def starts(self, data: bytes) -> list[list[int]]:
        """Runs [from, to, bits] of places at which matches of these rules begin: the one pass over all bytes.

        Places are counted from the end of ``data``, in rising order.
        """
        step, limit, accepts, state = self.step, self.first_accept, self.accepts, self.start
        runs: list[list[int]] = []
        for i, c in enumerate(data.translate(self.classes)[::-1]):
            state = step[state + c]
            if state >= limit:
                bits = accepts[state]
                if runs and runs[-1][1] == i and runs[-1][2] == bits:
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1, bits])
        return runs

    def scan(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by kind as the rules are listed, then start."""
        runs = self.starts(data)
        runs.reverse()
        n, spans = len(data), []
        for i, rule in enumerate(self.rules):
            at = 0
            for low, high, bits in runs:
                if not bits >> i & 1:
                    continue
                at = max(at, n - high)
                while at < n - low:
                    first, end = self._longest(data, at, 1 << i)
                    if end - at >= rule.least and end - first + 1 >= rule.least_tail:
                        spans.append((rule.kind, at, end))
                    at = end
        return spans

    def _longest(self, data: bytes, at: int, bit: int) -> tuple[int, int]:
        """Ends of the shortest and the longest match of a rule that begins here."""
        step, classes, ends, live, state = self.fore_step, self.fore_classes, self.ends, self.live, self.fore_start
        first = end = 0
        for here in range(at, len(data)):
            state = step[state + classes[data[here]]]
            if ends[state] & bit:
                end = here + 1
                first = first or end
            if not live[state] & bit:
                break
        return first, end


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Columns ``key`` and ``secrets``: an array of (kind, start, end) by start, then kind as the rules are listed.

    Positions are code points, the end is exclusive. Matches of one kind are leftmost and don't overlap; those that are
    too short are dropped after matching. Null and empty texts give an empty array. Only the key and the text are read;
    repeated rows give repeated results. A key named as the result is an error.
    """
    refuse_clashes(key, "secrets")
    scanner = Scanner(rules)
    shared = df.sparkSession.sparkContext.broadcast(scanner)  # transition arrays: bounded by the rules
    rank = {r.kind: i for i, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for batch in batches:
            raw, offsets = text_buffer(batch.column("t"))
            data = raw.tobytes()
            kinds, starts, ends, sizes = [], [], [], [0]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                one = data[a:b]
                found = scan(one)
                if found:
                    chars = np.concatenate([[0], np.cumsum((raw[a:b] & 0xC0) != 0x80)])
                    for kind, s, e in sorted(found, key=lambda x: (x[1], rank[x[0]])):
                        kinds.append(kind)
                        starts.append(int(chars[s]))
                        ends.append(int(chars[e]))
                sizes.append(len(kinds))
            spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)], names=[key, "secrets"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("secrets", T.ArrayType(span))])
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
