"""Conversation repair against a search over all states with whole edit strings."""

import hashlib
import random
import zlib

import pytest

from cairnfield.llm import repair
from cairnfield.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """rows: (role, text, must go, truncated). The least (cost, edits) with the repaired rows."""
    best = {"0": (0, "", ())}

    def inserts(best):
        for _ in range(2):
            for state, (cost, audit, left) in list(best.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if to := NEXT.get((state, x)):
                        new = (cost + 3, audit + "I", (*left, f"{role}:"))
                        best[to] = min(best.get(to, new), new)
        return best

    best = inserts(best)
    for role, text, gone, cut in rows:
        new = {}
        for state, (cost, audit, left) in best.items():
            made = [(state, (cost + 4, audit + "D", left))]
            if not gone:
                made += [(NEXT.get((state, role[:1])), (cost + 3 * cut, audit + "K", (*left, f"{role}:{text}")))]
                made += [(NEXT.get((state, x)), (cost + 3 + 3 * cut, audit + "R", (*left, f"{r}:{text}"))) for x, r in (("u", "user"), ("a", "assistant"))]
            for to, x in made:
                if to:
                    new[to] = min(new.get(to, x), x)
        best = inserts(new)
    return min(best[s] for s in ("0", "a") if s in best)


def brute(rows):
    """Faults and repair of one conversation; rows: (turn, role, text) after damage, without nulls in role and text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, left = cheapest(marked)
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()), left


def damaged(conv, turn, role, text):
    show = lambda x: " " if x is None else str(x)
    role, text = show(role), show(text)
    kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def made(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "ü!", "x.", "long. "]
    turn = lambda i: rng.choice([i, i, i, i + 7, None])
    good = lambda i: rng.choice(["user", "assistant"][i % 2 : i % 2 + 1] * 8 + roles)
    return [(conv, turn(i), good(i), rng.choice([*texts, f"word {i}.", f"word {i}"])) for i in range(n)]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_audits_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [r for conv in range(300) for r in made(rng, conv, rng.randint(1, 14))] + made(rng, None, 9) + made(rng, 900, 700)
    rows += [(901, 0, "user", "Hi.")] * 500 + [(902, None, None, None)]
    rows += [(903, i, ["user", "assistant"][i % 2], "x" * 300_000 + f"{i}.") for i in range(4)]
    want = {}
    for r in rows:
        want.setdefault(r[0], []).extend(damaged(*r))
    frame = spark.createDataFrame(rows, TURNS)
    frame.selectExpr("*", "1 as conv", "2 as here", "3 as n", "4 as fresh", "5 as present").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == brute(want[r.conv_id])[0], r.conv_id
    assert any(not w for w in want.values())  # a conversation that lost all rows


def test_rows_of_a_repair(spark):
    rng = random.Random(6)
    rows = [r for conv in range(40) for r in made(rng, conv, rng.randint(1, 10))]
    got = {}
    for r in repair.repair_turns(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append(r)
    for conv, edits in got.items():
        plain = [(t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows if c == conv]
        digest, left = brute(plain)
        assert "".join(e.edit for e in edits) == digest[6]
        assert tuple(f"{e.role}:{e.text}" for e in edits if e.edit != "D") == left
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_turns(empty).collect() == [] and repair.audit_conversations(empty).collect() == []


def test_memory_holds_the_unresolved_end_only():
    search, out = repair.Repair(), 0
    rng = random.Random(7)
    for i in range(20_000):
        out += sum(1 for _ in search.add(rng.choice(["user", "assistant"]), f"{i}.", rng.random() < 0.1, rng.random() < 0.2))
    assert search.most < 200 and out > 19_000
    nodes, todo = set(), [n for _, n in search.paths.values()]
    while todo:
        node = todo.pop()
        if node is not None and id(node) not in nodes:
            nodes.add(id(node))
            todo.append(node.parent)
    assert len(nodes) < 1000  # nothing before the anchor is held


@pytest.mark.parametrize("seed", range(4))
def test_ties_are_decided_by_whole_ends(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), f"{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randint(0, 9))]
        search, audit = repair.Repair(), ""
        for r in rows:
            audit += "".join(e[0] for e in search.add(*r))
        audit += "".join(e[0] for e in search.finish())
        assert (search.cost, audit) == cheapest(rows)[:2], rows
