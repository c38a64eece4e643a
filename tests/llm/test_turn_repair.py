"""Conversation repair: cheapest edits and least audits against plain recursion, whatever the block size."""

import hashlib
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from riskloom.llm import turn_repair as R

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    """{conv_id: rows after damage, in order} from (conv_id, turn, role, text)."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        own = found[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return found


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one conversation."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for new, price, letter in [(role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")]:
                    if new[:1] in after[state]:
                        cost, audit, out = best(i + 1, after[state][new[:1]], 0)
                        ways.append((cost + price + more, letter + audit, (f"{new}:{text}", *out)))
        if inserted < 4:
            for new in ("user", "assistant"):
                if new[0] in after[state]:
                    cost, audit, out = best(i, new[0], inserted + 1)
                    ways.append((cost + 3, "I" + audit, (f"{new}:", *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def expected(rows):
    found = damaged(rows)
    return sorted(((c, *plain(found[c])) for c in {r[0] for r in rows}), key=repr)


def repaired(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, block int, fault string, audit string")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in R.repair(R.damage(table)).select(names).collect()), key=repr)


def conversations(seed, count, most):
    random = np.random.default_rng(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ünïcode"]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", None, "é", "a. ", ".", "Yes.  "]
    rows = []
    for conv in range(count):
        for turn in range(random.integers(1, most)):
            rows.append((
                None if conv == 1 else 2**60 + conv if conv == 2 else conv, None if random.random() < 0.1 else int(turn + random.integers(0, 2)),
                roles[random.integers(0, len(roles))], texts[random.integers(0, len(texts))] if random.random() < 0.6 else f"text {random.integers(0, 99)}.",
            ))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_any_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = conversations(5, 80, 14)
    assert repaired(spark, rows) == expected(rows)


def test_one_conversation_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rows = conversations(8, 3, 4) + [(77, t, ["user", "assistant", "system"][t % 7 % 3], f"a{t % 40}" + ".!"[t % 2 :]) for t in range(150)]
    assert repaired(spark, rows) == expected(rows)


def test_dropped_whole_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repaired(spark, []) == []


def test_ties_take_the_least_audit():
    # The repeated row must go, and an empty assistant message may stand before or behind it.
    rows = [(0, "user", "a."), (1, "user", "a.")]
    assert plain(rows)[-3:-1] == (7, "KDI")
    solved = R.Solved(R._initials(["user", "user"]), np.array([0, R.DUPLICATE]), np.array([0, 2]), [R.END], [True])
    assert solved.costs[0][R.START] == 7
    assert R.rendered(solved.paths(np.array([R.START]))[0], ["user"] * 2, ["a.", "a."])[0] == "KDI"


def test_ranks_order_the_least_audits():
    random = np.random.default_rng(3)
    initials, faults = random.integers(0, 4, 40), random.integers(0, 4, 40)
    solved = R.Solved(initials, faults, np.array([0, 40]), [R.END], [True])
    audits = []
    for node in range(len(solved.ends)):
        out = ""
        while not solved.ends[node]:
            out, node = out + R.LETTERS[solved.letter[node] - 1], solved.pointers[0][node]
        audits.append(out)
    assert [sorted(set(audits)).index(a) for a in audits] == solved.ranks.tolist()


def test_full_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in R.op13_turn_repair(spark, sf_dir).collect()), key=repr) == expected(rows)
