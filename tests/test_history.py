"""The message budget against the rule written out, conversation by conversation."""

import random
import re

from siltstone.operators import memory

PIECE = re.compile(r"\s*(?:[A-Za-z0-9_À-ɏ]+|[^\sA-Za-z0-9_À-ɏ])")


def count(t):
    return len(PIECE.findall(t or ""))


def first(t, n):
    return "".join(PIECE.findall(t or "")[: max(0, n)])


def expect(rows, budget):
    if sum(count(t) for _, _, t in rows) <= budget:
        return rows
    kept = [list(r) for i, r in enumerate(rows) if r[1] == "system" or i == len(rows) - 1]
    if sum(count(t) for _, _, t in kept) <= budget:
        return [tuple(r) for r in kept]
    system, last = [r for r in kept if r[1] == "system"], kept[-1]
    s, n = sum(count(r[2]) for r in system), 0 if last[1] == "system" else count(last[2])
    if last[1] == "system" or s / (s + n) > 0.8:
        room = budget - n
        for r in system:
            r[2], room = first(r[2], room), room - min(count(r[2]), max(0, room))
    else:
        last[2] = first(last[2], budget - s)
    return [tuple(r) for r in kept]


def test_history_against_the_rule(spark):
    rng = random.Random(5)
    talks = {}
    for conv in range(120):
        roles = [rng.choice(["system", "user", "user", "assistant"]) for _ in range(rng.randrange(1, 6))]
        talks[conv] = [(i, r, " ".join(rng.choice(["ab", "c,", "中文", "x\ny"]) for _ in range(rng.choice([0, 2, 9, 30])))) for i, r in enumerate(roles)]
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    frame = spark.createDataFrame(rows, "conv int, turn int, role string, content string")
    for budget in (5, 20, 60):
        found = {}
        for r in memory.history_fit(frame, "conv", "turn", "role", "content", budget).collect():
            found.setdefault(r["conv"], []).append((r["turn"], r["role"], r["content"]))
        assert {c: sorted(v) for c, v in found.items()} == {c: expect(t, budget) for c, t in talks.items()}


def test_ties_and_nulls(spark):
    rows = [(1, 0, "user", "a b c d e"), (1, 1, "user", "x"), (1, 1, "user", "y z"), (1, 0, None, None)]
    found = memory.history_fit(spark.createDataFrame(rows, "conv int, turn int, role string, content string"), "conv", "turn", "role", "content", 4).collect()
    assert [tuple(r) for r in found] == [(1, 1, "user", "y z")]
