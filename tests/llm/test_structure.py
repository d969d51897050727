"""Conversation repair against a plain forward search, over blocks of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallymark.llm import structure

SPACES = " \t\n\x0b\f\r"
INSERTS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def brute_repair(rows):
    """Least (cost, edits, lines) by state, row by row; and the figures."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def with_inserts(best):
        for _ in range(3):
            for state, (to, role) in INSERTS.items():
                if state in best:
                    cost, edits, lines = best[state]
                    other = (cost + 2, edits + "I", lines + [f"{role}:"])
                    best[to] = min(best.get(to, other), other)
        return best

    best = with_inserts({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, *found):
            new[state] = min(new.get(state, found), found)

        for state, (cost, edits, lines) in best.items():
            offer(state, cost + 3, edits + "D", lines)
            if fault in ("", "truncated"):
                paid = cost + (fault == "truncated")
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, role[:1]))
                if to:
                    offer(to, paid, edits + "K", lines + [f"{role}:{text}"])
                to, due = INSERTS[state]
                offer(to, paid + 2, edits + "R", lines + [f"{due}:{text}"])
        best = with_inserts(new)
    cost, edits, lines = min(best[s] for s in (0, 3) if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_audit(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        dice = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        by[conv]
        if dice:
            role = "user" if dice == 4 else role
            text = "" if dice == 1 else text.translate(str.maketrans("", "", ".!?")) if dice == 2 else text
            by[conv] += [(turn, role, text)] * (2 if dice == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        out.append((conv, *brute_repair(own)))
    return sorted(out, key=repr)


def some_turns():
    dice = random.Random(5)
    texts = ["Yes.", "No!", "open", "", " \n", "what?", "end.\x0b", "été.", "x" * 3000 + ".", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "a"]
    rows = []
    for conv in range(60):
        turns = list(range(dice.randrange(1, 14)))
        for turn in turns:
            role = dice.choice(roles) if dice.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if dice.random() < 0.05 else turn * dice.choice([1, 1, 1, 2]), role, dice.choice(texts)))
    rows += [(None, t, ("user", "assistant")[t % 2], f"say {t}.") for t in range(9)]
    rows += [(500, t, dice.choice(roles), dice.choice(texts) if t % 3 else f"text {t}.") for t in range(400)]  # many blocks
    rows += [(501, 3, "user", "again.")] * 30 + [(502, None, "user", "a."), (502, None, "user", "b.")]
    return rows


@pytest.mark.parametrize("least", [64, 3])
def test_audit_equals_forward_search(spark, monkeypatch, least):
    monkeypatch.setattr(structure, "LEAST_BLOCK", least)
    rows = some_turns()
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, c string")
    out = structure.audit(structure.damaged(given), given)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_audit(rows)


def test_repaired_rows_take_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "More."), (1, 2, "user", "what"), (2, 0, "user", " ")]
    told = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines, figures = structure.repaired(told)
    said = [(r.c, r.role, r.text) for r in lines.orderBy("c", "pos", "step").collect()]
    assert [r for _, r, _ in said] == ["user", "assistant"] * (len(said) // 2)
    assert {r.c: r.audit for r in figures.collect()}["=2"] == "D"


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure.audit(structure.damaged(empty), empty).count() == 0


def test_block_costs_are_the_vectors_of_the_block():
    dice = random.Random(1)
    for n in (1, 5, 40):
        codes = bytes(dice.randrange(12) for _ in range(n))
        after = structure.LEFT
        assert ((structure.block_costs(codes) + after).min(1) == structure.vectors(codes, after)[0]).all()
