"""Repair of conversations against plain enumeration of edits, whole and in blocks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kinetrail.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, absent boolean, part int, pos long, live boolean, hash long, copies int, audit string"
SPACE = " \t\n\x0b\x0c\r"


def flaws(rows):
    """(must go, truncated, which fault) of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        kept = text.strip(SPACE)
        name = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(name)
    return out


def enumerated(rows):
    """Cheapest (cost, audit, repaired) by trying every edit of every row, with up to two inserts between rows."""
    names, best = flaws(rows), None
    gaps = ["", "I", "II"]
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and n in ("blank", "duplicate") for e, n in zip(edits, names)):
            continue
        base = sum({"D": 4, "K": 0, "R": 3}[e] + 3 * (e != "D" and n == "truncated") for e, n in zip(edits, names))
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, inserts))
            if best is not None and cost > best[0]:
                continue
            audit = "".join(i + e for i, e in zip(inserts, edits)) + inserts[-1]
            made = []
            for i, (e, (role, text)) in zip(inserts, zip(edits, rows)):
                made += [("?", "")] * len(i) + ([] if e == "D" else [(role, text)] if e == "K" else [("?", text)])
            made += [("?", "")] * len(inserts[-1])
            with_system = len(made) % 2
            want = "s" * with_system + "ua" * (len(made) // 2)
            if with_system and (len(made) == 1 or made[0][0][:1] != "s"):
                continue
            if any(r != "?" and r[:1] != w for (r, _), w in zip(made, want)):
                continue
            full = {"s": "system", "u": "user", "a": "assistant"}
            fixed = [(full[w] if r == "?" else r, t) for (r, t), w in zip(made, want)]
            best = min(best or (1 << 60,), (cost, audit, fixed))
    return best


def plain(rows):
    """The same for rows of any number: least (cost, audit) for each nonterminal, as whole strings."""
    names = flaws(rows)

    def close(s):
        s = dict(s)
        for _ in range(4):
            for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if a in s:
                    x = (s[a][0] + 3, s[a][1] + "I")
                    s[b] = min(s.get(b, x), x)
        return s

    s = {0: (0, "")}
    for (role, _), name in zip(rows, names):
        t = {}

        def offer(k, cost, audit):
            t[k] = min(t.get(k, (cost, audit)), (cost, audit))

        for k, (cost, audit) in close(s).items():
            offer(k, cost + 4, audit + "D")
            if name not in ("blank", "duplicate"):
                more = 3 * (name == "truncated")
                to = {0: 2, 1: 2, 3: 2, 2: 3}[k]
                offer(to, cost + 3 + more, audit + "R")
                if role[:1] == ("a" if k == 2 else "u"):
                    offer(to, cost + more, audit + "K")
                if k == 0 and role[:1] == "s":
                    offer(1, cost + more, audit + "K")
        s = t
    s = close(s)
    cost, audit = min(s[k] for k in (0, 3) if k in s)
    made, left, n = [], iter(rows), audit.replace("D", "")
    want = "s" * (len(n) % 2) + "ua" * (len(n) // 2)
    k = 0
    for x in audit:
        row = next(left) if x != "I" else None
        if x == "D":
            continue
        full = {"s": "system", "u": "user", "a": "assistant"}[want[k]]
        made.append((full, "") if x == "I" else (row[0] if x == "K" else full, row[1]))
        k += 1
    return cost, audit, made


def expected(table):
    """The query's rows from (conv_id, turn, role, text)."""
    by = {}
    for c, t, r, x in table:
        r, x = (" " if r is None else r), (" " if x is None else x)
        by.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        by[c] += [(t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    out = {}
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        names = flaws([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, made = plain([r[1:] for r in rows])
        firsts = [r[1][:1] for r in rows]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(names.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def random_rows(r, n):
    texts = ["Yes.", "No!", "What?", "cut off", "", " \t", "Yes. ", "über", "more words here."]
    return [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", "sys", ""]), r.choice(texts) if r.random() < 0.5 else f"{r.random()}.") for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_parse_equals_enumeration(seed):
    r = random.Random(seed)
    rows = random_rows(r, r.randint(0, 5))
    found, made = cv.parsed([(0, *x) for x in rows], cv.Chart())
    cost, audit, fixed = enumerated(rows)
    assert (found["cost"], found["audit"], [m[:2] for m in made]) == (cost, audit, fixed)
    assert plain(rows) == (cost, audit, fixed)


def test_long_parses_equal_whole_strings():
    r, chart = random.Random(5), cv.Chart()
    for _ in range(300):
        rows = random_rows(r, r.randint(6, 60))
        found, made = cv.parsed([(0, *x) for x in rows], chart)
        assert (found["cost"], found["audit"], [m[:2] for m in made]) == plain(rows)
    assert len(chart.known) < 3000


def conversations(seed):
    r = random.Random(seed)
    out = [(c, t, *random_rows(r, 1)[0]) for c in range(40) for t in range(r.randint(1, 9)) if r.random() < 0.9]
    out += [(100, t, ["user", "assistant"][t % 2 if r.random() < 0.9 else 0], f"turn {t % 150}.") for t in range(900)]
    out += [(None, 0, "user", "Hi."), (None, 1, None, "x."), (None, 2, "assistant", None), (7, None, "system", "Be kind."), (8, None, None, None)]
    out += [(41, 3, "user", "a" * 200_000 + "."), (42, 5, "user", "Same."), (42, 5, "user", "Same."), (43, -3, "user", ""), (44, 1 << 40, "assistant", "Far.")]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*out, (dropped, 0, "user", "Gone.")]


@pytest.mark.parametrize("hold", [1 << 16, 3])
def test_repair(spark, monkeypatch, hold):
    monkeypatch.setattr(cv, "HOLD_ROWS", hold)
    table = conversations(1)
    df = spark.createDataFrame([(*x, True, 1, 2, False, 3, 4, "z") for x in table], SCHEMA).repartition(5)
    rows = cv.damaged(df)
    found, repaired = cv.repair(rows, rows_too=True)
    got = {x[0]: tuple(x[1:]) for x in found.collect()}
    assert got == expected(table)
    made = {}
    for x in sorted(repaired.collect(), key=lambda x: x.pos):
        made.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for c, x in got.items():
        assert hashlib.sha256("\n".join(made.get(c, [])).encode()).hexdigest() == x[-1]


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(cv, "partitions_for", lambda df: 9)
    r = random.Random(8)
    table = [(1, t, ["user", "assistant", "system"][t % 3 if r.random() < 0.3 else t % 2], f"turn {t % 700}" + r.choice(["", ".", "?"])) for t in range(2000)]
    df = spark.createDataFrame([(*x, True, 1, 2, False, 3, 4, "z") for x in table], SCHEMA)
    assert {x[0]: tuple(x[1:]) for x in cv.repair(cv.damaged(df))[0].collect()} == expected(table)


def test_no_rows(spark):
    found, repaired = cv.repair(cv.damaged(spark.createDataFrame([], SCHEMA)), rows_too=True)
    assert found.collect() == [] and repaired.collect() == []
