"""Conversation repair against an exhaustive search over edit scripts, in one block and in many."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from cellscape.llm import queries as Q
from cellscape.llm.conversation_repair import damaged_and_repaired, repair

SF = "/root/testdata/sf0.001"


def told(rows):
    """Faults of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def scripts(rows, marks, at, roles):
    """(cost, audit, lines) of every way to edit the rows from `at` on, with at most one insertion before each row and at the end."""
    ends = [(0, "", [])] if at == len(rows) else []
    if at < len(rows):
        role, text = rows[at]
        ends += [(c + 2, "D" + a, lines) for c, a, lines in scripts(rows, marks, at + 1, roles)]
        if marks[at] not in ("blank", "duplicate"):
            more = 5 if marks[at] == "truncated" else 0
            for new, cost, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                ends += [(c + cost + more, letter + a, [(new, text), *lines]) for c, a, lines in scripts(rows, marks, at + 1, roles)]
    return ends


def brute(rows):
    """The cheapest and ASCII-least audit and its text, insertions tried everywhere."""
    marks, best = told(rows), None
    for cost, audit, lines in scripts(rows, marks, 0, None):
        for spots in itertools.product(("", "user", "assistant"), repeat=len(audit) + 1):
            a, out, k = "", [], 0
            for letter, spot in itertools.zip_longest(audit, spots):
                if spot:
                    a, out = a + "I", [*out, (spot, "")]
                if letter:
                    a += letter
                    if letter != "D":
                        out, k = [*out, lines[k]], k + 1
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                whole = cost + 5 * sum(map(bool, spots))
                if best is None or (whole, a) < best[:2]:
                    best = (whole, a, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def plain(rows):
    """The contract's row of conversations [(turn, role, text)] by a walk over all edit scripts that keeps the best at each state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, t) for _, r, t in rows]
    marks = told(pairs)
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
    ways = {"": (0, "", [])}  # by the last role's initial

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def step(state, initial):
        return initial if (initial == "s" and state == "") or (initial == "u" and state != "u") or (initial == "a" and state == "u") else None

    def inserted(ways):
        out = dict(ways)
        for state, (c, a, lines) in ways.items():
            for role in ("user", "assistant"):
                if step(state, role[:1]):
                    put(out, role[:1], (c + 5, a + "I", [*lines, f"{role}:"]))
        return out

    for (role, text), mark in zip(pairs, marks, strict=True):
        out = {}
        for state, (c, a, lines) in inserted(ways).items():
            put(out, state, (c + 2, a + "D", lines))
            if mark not in ("blank", "duplicate"):
                for new, cost, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if step(state, new[:1]):
                        put(out, new[:1], (c + cost + 5 * (mark == "truncated"), a + letter, [*lines, f"{new}:{text}"]))
        ways = out
    ways = inserted(ways)
    cost, audit, lines = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def harmed(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", "umpire"], ["A b.", "C d?", "e", " ", "", "\x0b\t", "F!\n", "A b"]
    rows = [(int(c), int(t), str(rng.choice(roles, p=[0.35, 0.35, 0.1, 0.1, 0.05, 0.05])), str(rng.choice(texts))) for c in range(60) for t in range(int(rng.integers(1, 9)))]
    rows += [(100, int(t), str(rng.choice(["user", "assistant"])), f"{t % 700}.") for t in range(900)]
    return [*rows, (101, None, None, None), (101, None, "user", "x."), (101, 4, "assistant", "y."), (None, 1, "user", "u."), (None, 2, "assistant", "long " * 50_000), (102, 3, "user", "same."), (102, 3, "user", "same.")]


def test_the_walk_equals_all_edit_scripts():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = [(str(rng.choice(["user", "assistant", "system", "x"])), str(rng.choice(["a.", "b.", "c", ""]))) for _ in range(int(rng.integers(0, 4)))]
        want = brute(rows)
        got = plain([(i, *r) for i, r in enumerate(rows)])
        assert (got[5], got[6], got[7]) == (want[0], want[1], hashlib.sha256(want[2].encode()).hexdigest())


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_op13_on_odd_conversations(spark, odd, block_rows):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cost", "'x' AS fault")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in damaged_and_repaired(df, block_rows).collect()}
    left = harmed(odd)
    assert got == {c: plain(rows) for c, rows in left.items()}


def test_op13_on_the_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in Q.op13_conversation_repair(spark, SF).collect()}
    assert got == {c: plain(own) for c, own in harmed(rows).items()} and len(got) == len({r[0] for r in rows})


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert damaged_and_repaired(empty).count() == 0 and repair(empty).count() == 0
