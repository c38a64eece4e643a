"""Chat formatting: legal results of least cost, whatever the chunk size."""

from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from riskloom.llm import chat_format as C


def least_cost(roles):
    """Cheapest of all sequences of actions, by enumeration."""
    best = float("inf")

    def walk(k, state, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(roles):
            if state == C.SYSTEM:
                cost += C.INSERT
            best = min(best, cost)
            return
        role = roles[k]
        change = lambda q: 0 if q == role else C.UNKNOWN if role == C.START else C.RELABEL
        for q in C.LEGAL[state]:
            walk(k + 1, q, cost + change(q))
            if q != C.SYSTEM:
                for r in C.LEGAL[q]:
                    walk(k + 1, r, cost + C.INSERT + change(r))
        if state != C.START:
            walk(k + 1, state, cost + C.MERGE + change(state))

    walk(0, C.START, 0.0)
    return best


def test_matrices_give_the_least_cost():
    for n in range(1, 6):
        for roles in product(range(4), repeat=n):
            total = np.where(np.arange(4) == C.START, 0.0, np.inf)
            for r in roles:
                total = (total[:, None] + C.MATRICES[r]).min(0)
            assert (total + C.END).min() == least_cost(roles)


def check(rows, conversations):
    """``conversations``: {conv_id: [(role, text)] in order}."""
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.place, r.part)):
        found[r.conv_id].append(r)
    assert set(found) == set(conversations)
    for conv, turns in conversations.items():
        own = found[conv]
        kept = [r for r in own if r.action != "insert"]
        assert [r.text for r in kept] == [C._broken(t) for _, t in turns] and [r.place for r in kept] == list(range(1, len(turns) + 1))
        messages = [(r.role, []) for r in own if r.action != "merge"]
        at = -1
        for r in own:
            at += r.action != "merge"
            assert r.role == messages[at][0]
            messages[at][1].append(r.text)
        state = C.START
        for role, _ in messages:
            new = C.ROLES.index(role)
            assert new in C.LEGAL[state]
            state = new
        assert state != C.SYSTEM
        text = "".join(f"<|im_start|>{role}\n" + "\n".join(parts) + "<|im_end|>\n" for role, parts in messages)
        assert "".join(r.rendered for r in own) == text
        total = np.where(np.arange(4) == C.START, 0.0, np.inf)
        for role, _ in turns:
            total = (total[:, None] + C.MATRICES[C.role_of(role)]).min(0)
        assert sum(r.cost for r in own) == (total + C.END).min()


@pytest.mark.parametrize("chunk", [512, 3])
def test_any_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    random = np.random.default_rng(6)
    names = ["user", "assistant", "system", "Human ", "GPT", None, "tool", ""]
    conversations = {
        int(i): [(names[random.integers(0, 8)], f"t{k} <|im_end|>") for k in range(random.integers(1, 40))] for i in range(60)
    }
    conversations[None] = [("user", "n0"), ("user", None), ("assistant", "n2")]
    conversations[99] = [("system", "only")]
    rows = [(c, k, r, t, 1.5, "x") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, cost double, rendered string")
    check(C.repair(table).collect(), conversations)
    assert C.repair(table.limit(0)).count() == 0


def test_ties_and_missing_turns(spark):
    rows = [(1, None, "assistant", "last"), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 2, "assistant", "a"), (1, 0, None, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    check(C.repair(table).collect(), {1: [(None, ""), ("assistant", "a"), ("user", "b"), ("user", "b"), ("assistant", "last")]})


def test_full_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conversations = defaultdict(list)
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        conversations[r.conv_id].append((r.role, r.text))
    check(C.op7_chat_format(spark, sf_dir).collect(), conversations)
