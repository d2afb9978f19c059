"""Conversation repair: cheapest and least edits against dynamic programming."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from litgraph.llm import dialogue

NEXT = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
MADE = {"0": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def least(rows):
    """(cost, edits) by dynamic programming; rows: (initial, fault)."""
    best = {"0": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for initial, fault in reversed(rows):
        extra = 3 if fault == "truncated" else 0
        now = {}
        for state in "0sua":
            options = [(4, "D", state)]
            if fault in (None, "truncated"):
                options.append((3 + extra, "R", MADE[state]))
                if initial in NEXT[state]:
                    options.append((extra, "K", NEXT[state][initial]))
            now[state] = min((c + best[s][0], e + best[s][1]) for c, e, s in options)
        for _ in range(4):
            for state in "0sua":
                c, e = now[MADE[state]]
                now[state] = min(now[state], (c + 3, "I" + e))
        best = now
    return best["0"]


def brute(conv_id, rows):
    """The result row of a conversation after damage; rows: (turn, role, text)."""
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in order:
        last = re.findall("[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen
                      else None if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in order]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = least(list(zip(initials, faults, strict=True)))
    state, out, at = "0", [], 0
    for e in audit:
        if e != "D":
            state = NEXT[state][initials[at]] if e == "K" else MADE[state]
            role = order[at][1] if e == "K" else ROLE[state]
            out.append(f"{role}:{'' if e == 'I' else order[at][2]}")
        at += e != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return conv_id, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kept = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def some_rows(n, seed, turns=9):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "User", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why? ", "a. ", None, "one.", "two.", "three?", "é"]
    return [(c, rnd.choice([t, t, t, t + 1, None]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < .5 else f"text {rnd.random()}.")
            for c in range(n) for t in range(rnd.randint(1, turns))]


def compare(spark, rows, schema="conv_id long, turn long, role string, text string"):
    got = dialogue.repair_digests(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want = [brute(c, r) for c, r in damage([x[:4] for x in rows]).items()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_dynamic_programming(seed):
    rnd = random.Random(seed)
    faults = [None, "truncated", "blank"]
    for _ in range(400):
        rows = [(rnd.choice("sssuuuaaax"), rnd.choice(faults[:2])) for _ in range(rnd.randint(0, 40))]
        codes = bytes("suax".index(i) * 2 + (f is not None) for i, f in rows)
        cost, edits, state = dialogue.solve(codes, [0], dialogue._END)[0]
        edits += "I" * (dialogue._END[state] // dialogue._OTHER)
        assert (cost // 2, edits) == least(rows)


def test_estimates_never_exceed_the_cost():
    rnd = random.Random(3)
    for _ in range(300):
        rows = bytes(rnd.randrange(8) for _ in range(rnd.randint(1, 10)))
        need = dialogue._estimates(rows, dialogue._END)
        for i in range(len(rows)):
            for state in range(4):
                assert need[i][state] <= dialogue.cheapest(rows[i:], state, dialogue._END)[0]


def test_conversations_equal_brute_force(spark):
    rows = some_rows(150, 1) + [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (900, None, None, None)]
    rows += [(901, 5, "user", "Same.")] * 3 + [(902, t, "user", "Same.") for t in range(30)]
    rows = [(*r, "x", 2) for r in rows]
    got = compare(spark, rows, "conv_id long, turn long, role string, text string, audit string, copies int")
    assert {c for r in got for c in r.audit} == set("DIKR")
    assert any(r.audit == "" for r in got) or any(set(r.audit) == {"D"} for r in got)


def test_long_conversations_in_parts(spark, monkeypatch):
    """A conversation over several ranges and parts, among short ones."""
    rnd = random.Random(7)
    rows = some_rows(40, 2)
    rows += [(20_000, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"{rnd.randrange(2500)} and so on" + rnd.choice(".,"))
             for t in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_equal_the_whole():
    """Parts of any size, put together, give the solution of the whole."""
    rnd = random.Random(11)
    for _ in range(30):
        rows = [(t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.randrange(3), rnd.random() < .1, rnd.choice([0, 1, 1, 2]))
                for t in range(rnd.randint(1, 60))]
        whole = dialogue.Part(1)
        for r in rows:
            whole.add(*r)
        want = whole.row(0, True)
        parts, size = [], rnd.randint(1, 20)
        for lo in range(0, len(rows), size):
            p = dialogue.Part(1)
            for r in rows[lo:lo + size]:
                p.add(*r)
            parts.append(p.row(lo, False)[12:14])
        assert dialogue._least(parts) == (want[12][0] // 2, want[13][0])


def test_repaired_rows_are_the_output(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Again?"), (1, 3, "assistant", "Yes."), (2, 1, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    solved = dialogue.audits(table).cache()
    assert {(r.conv_id, r.cost, r.audit) for r in solved.collect()} == {(1, 3, "KIKK"), (2, 4, "D")}
    got = dialogue.repaired(table, solved).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.role, r.text) for r in got] == [
        (1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Again?"), (1, 3, "assistant", "Yes.")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_digests(empty).collect() == []
