"""Conversation structure repair: cheapest edits by dynamic programming, least audit by prefix doubling.

A repaired conversation is empty, or an optional system message followed by pairs of user and
assistant. Rows may be kept, given another role or deleted, and empty messages may be inserted
anywhere; blank rows and duplicates must go. The nodes of the problem are (row, role of the
last message). Going backwards, dynamic programming gives every node the least cost to the end;
an edit that keeps to that cost is an optimal arc, and its initial (D, I, K or R) a letter of
the audit. Optimal-arc nodes are then ranked by their least audits of 1, 2, 4, ... letters: the
rank for twice the length comes from a node's rank and the rank of the node that its doubled
pointer leads to. From one node no two arcs share a letter, so the first ranks already select
a node's arc, a path is known by its audit, and a block of rows needs nothing of later rows but
their costs. The path is read off the doubled pointers for all its letters at once.

Conversations of at most ``BLOCK`` rows are dealt by their id and solved in batches. Longer ones are cut
into blocks: rows are numbered by distributed running totals, every block becomes a min-plus
matrix between the four states, suffix costs and then entry states come from doubling over the
block numbers, and each block is solved on its own. Only the final digest of one long
conversation, which is sequential by nature, streams through one task, block by block.

Defined results: a null conversation id is a conversation of its own; a null role or text is
one space, and so is a null id or turn in the key that decides on damage; rows of one turn go
by role, the first ``HEAD`` characters of the text and then its hash; repeated rows are rows of
their own (and so duplicates); a role's initial is its first character, whatever the role; a
row with an unknown initial can only change its role or go; a conversation without rows after
damage has zeros, an empty audit and the digest of an empty text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.joins import broadcast_if_small
from riskloom.operators.ordering import running_totals
from riskloom.session import materialize

#: Rows of a block; a conversation of more rows is solved by several tasks.
BLOCK = 4_096
#: Rows and characters solved together in a batch of whole conversations.
BATCH_ROWS, BATCH_CHARS = 8_192, 16 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state after a user or assistant message that is legal in each state.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of an audit in ASCII order, and the arc each stands for.
LETTERS = "DIKR"
SPACES = " \t\n\x0b\x0c\r"
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)
#: More than any path costs, also after many sums.
NEVER = 1 << 60
#: Ids travel as text, so that a batch with a null among them keeps every digit.
_KEY = "conv_id string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the hash of id and turn; a dropped row stays, marked, so that no id is lost."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        shown("role").alias("role"), shown("text").alias("text"),
        (F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(times)).drop("kind", "copy")


#: Order of the rows of a conversation. Only the beginning of a text is compared, so that no
#: whole texts are sampled for ranges; texts that agree so far go by their hash.
HEAD = 256


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, HEAD), F.xxhash64("text")]


def _marked(rows: DataFrame) -> DataFrame:
    """Adds the fault a row has of itself: blank or truncated."""
    bare = F.btrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(CLEAN)
    return rows.withColumn("fault", fault.cast("int"))


# --- cost and arcs ------------------------------------------------------------------------


def _actions(initial: int, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each state, (letter, state afterwards, cost) of the edits of a row."""
    out = []
    for state in range(4):
        found = [(0, state, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            if initial == NEXT[state] or (state == START and initial == SYSTEM):
                found.append((2, initial, more))
            if initial != NEXT[state]:
                found.append((3, NEXT[state], REROLE + more))
        out.append(found)
    return out


ACTIONS = [[_actions(initial, fault) for fault in range(4)] for initial in range(4)]


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with any number of inserted messages ahead; three lead back to where the first led."""
    one = [INSERT + costs[NEXT[q]] for q in range(4)]
    two = [2 * INSERT + costs[NEXT[NEXT[q]]] for q in range(4)]
    return tuple(min(costs[q], one[q], two[q]) for q in range(4))


END = _closed([0, NEVER, NEVER, 0])


@lru_cache(maxsize=1 << 16)
def _step(initial: int, fault: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Costs before a row, and the state each optimal arc leads to by state and letter (-1: none).

    ``after`` is the cost of each state behind the row. The arc I stays before the row.
    """
    ways = ACTIONS[initial][fault]
    costs = _closed([min(c + after[t] for _, t, c in ways[q]) for q in range(4)])
    arcs = []
    for q in range(4):
        row = [-1, -1, -1, -1]
        for letter, target, c in ways[q]:
            if c + after[target] == costs[q]:
                row[letter] = target
        if INSERT + costs[NEXT[q]] == costs[q]:
            row[1] = NEXT[q]
        arcs.append(tuple(row))
    return costs, tuple(arcs)


def backward(initials: np.ndarray, faults: np.ndarray, after: tuple[int, ...]) -> tuple[tuple[int, ...], np.ndarray]:
    """Costs before the first row, and optimal arcs of every (row, state) as (n, 4, 4) states."""
    arcs: list = [None] * len(initials)
    pairs = list(zip(initials.tolist(), faults.tolist()))
    base = 0
    for k in range(len(pairs) - 1, -1, -1):
        least = min(after)  # kept apart, so that few different steps are worked out
        base += least
        after, arcs[k] = _step(*pairs[k], tuple(min(a - least, NEVER) for a in after))
    return tuple(a + base for a in after), np.array(arcs, np.int64).reshape(len(pairs), 4, 4)


def least_audits(arcs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Ranks of nodes by their least audits, their doubled pointers and first letters.

    ``arcs`` holds, for n nodes, the node each letter leads to (-1: none); ``ends`` marks the
    nodes where an audit ends, which sort before all letters and point to themselves.
    """
    n = len(arcs)
    here = np.arange(n)
    letter = np.where(ends, 0, (arcs >= 0).argmax(1) + 1)
    pointers = [np.where(ends, here, arcs[here, np.maximum(letter - 1, 0)])]
    ranks = letter
    while True:
        pointer = pointers[-1]
        ranks = np.unique(ranks * (int(ranks.max()) + 1) + ranks[pointer], return_inverse=True)[1]
        pointers.append(pointer[pointer])
        if ends[pointers[-1]].all():
            return ranks, pointers, letter


def read_path(pointers: list[np.ndarray], ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the paths from ``entry`` without the ends, and which path each belongs to."""
    steps = np.zeros(len(entry), np.int64)
    at = entry.copy()
    for k in range(len(pointers) - 1, -1, -1):  # the longest walk that does not reach an end
        further = pointers[k][at]
        going = ~ends[further]
        steps[going] += 1 << k
        at[going] = further[going]
    steps = np.where(ends[entry], 0, steps + 1)
    owner = np.repeat(np.arange(len(entry)), steps)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
    nodes = entry[owner]
    for k in range(len(pointers)):
        far = (index >> k) & 1 == 1
        nodes[far] = pointers[k][nodes[far]]
    return nodes, owner


class Solved:
    """Least paths through consecutive blocks of rows.

    Node 4 r + q stands before row r (rows of all blocks in one sequence) in state q; each block
    has four more nodes behind its last row.
    """

    def __init__(self, initials: np.ndarray, faults: np.ndarray, bounds: np.ndarray, after: list[tuple[int, ...]], last: list[bool]):
        count = len(bounds) - 1
        self.first = bounds[:-1] + np.arange(count)  # one place more per block
        places = int(bounds[-1]) + count
        arcs = np.full((places, 4, 4), -1, np.int64)
        ends = np.zeros((places, 4), bool)
        self.costs = []
        for b in range(count):
            low, high, at = int(bounds[b]), int(bounds[b + 1]), int(self.first[b])
            costs, found = backward(initials[low:high], faults[low:high], after[b])
            self.costs.append(costs)
            step = np.array([1, 0, 1, 1])  # I stays, the other edits take the row
            place = at + np.arange(high - low)
            arcs[at : at + high - low] = np.where(found >= 0, 4 * (place[:, None, None] + step) + found, -1)
            behind = at + high - low
            ends[behind] = True
            if last[b]:
                for q in range(4):
                    if END[q]:
                        arcs[behind, q, 1] = 4 * behind + NEXT[q]
                        ends[behind, q] = False
        self.arcs, self.ends = arcs.reshape(-1, 4), ends.ravel()
        self.ranks, self.pointers, self.letter = least_audits(self.arcs, self.ends)

    def exits(self) -> np.ndarray:
        """State behind each block for each of the four states before it."""
        far = self.pointers[-1].reshape(-1, 4)
        return far[self.first] % 4

    def paths(self, entry: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (in the block), letters and states afterwards, for the entry state of each block."""
        nodes, owner = read_path(self.pointers, self.ends, 4 * self.first + entry)
        rows, letters, states = nodes // 4 - self.first[owner], self.letter[nodes] - 1, self.pointers[0][nodes] % 4
        cuts = np.searchsorted(owner, np.arange(len(self.first) + 1))
        return [(rows[a:b], letters[a:b], states[a:b]) for a, b in zip(cuts, cuts[1:])]


def rendered(path: tuple[np.ndarray, np.ndarray, np.ndarray], roles: list[str], texts: list[str]) -> tuple[str, list[str]]:
    """Audit of a path and its repaired messages."""
    audit, out = [], []
    for row, letter, state in zip(*(p.tolist() for p in path)):
        audit.append(LETTERS[letter])
        if letter == 1:
            out.append(f"{NAMES[state]}:")
        elif letter == 2:
            out.append(f"{roles[row]}:{texts[row]}")
        elif letter == 3:
            out.append(f"{NAMES[state]}:{texts[row]}")
    return "".join(audit), out


# --- conversations of one block ---------------------------------------------------------------


def _initials(roles) -> np.ndarray:
    return np.array([INITIALS.get(r[:1], START) for r in roles], np.int64)


def _illegal(initials: np.ndarray) -> int:
    """Adjacent initials other than su, ua and au."""
    one, two = initials[:-1], initials[1:]
    legal = ((two == USER) & ((one == SYSTEM) | (one == ASSISTANT))) | ((one == USER) & (two == ASSISTANT))
    return int((~legal).sum())


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


EMPTY_HASH = hashlib.sha256(b"").hexdigest()
_RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _int(value):
    return None if pd.isna(value) else int(value)


def _solve_short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole conversations, whose rows arrive together and in order."""
    held: list[tuple] = []  # (conv_id, turns, roles, texts, faults)
    rows = chars = 0
    for frame in frames:
        conv, present = frame["conv_id"].tolist(), frame["present"].tolist()
        for c, here, turn, role, text, fault in zip(
            conv, present, frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist(), frame["fault"].tolist()
        ):
            if not held or held[-1][0] != c:
                if rows > BATCH_ROWS or chars > BATCH_CHARS:
                    yield _batch(held)
                    held, rows, chars = [], 0, 0
                held.append((c, [], [], [], [], set()))
            own = held[-1]
            if here:
                pair = (role, text)
                if fault != BLANK and pair in own[5]:
                    fault = DUPLICATE
                own[5].add(pair)
                own[1].append(_int(turn))
                own[2].append(role)
                own[3].append(text)
                own[4].append(fault)
                rows, chars = rows + 1, chars + len(text)
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pd.DataFrame:
    initials = _initials([r for own in held for r in own[2]])
    faults = np.array([f for own in held for f in own[4]], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(own[2]) for own in held])]).astype(np.int64)
    solved = Solved(initials, faults, bounds, [END] * len(held), [True] * len(held))
    out = []
    for own, costs, path, low, high in zip(held, solved.costs, solved.paths(np.full(len(held), START)), bounds, bounds[1:]):
        conv, turns, roles, texts, found, _ = own
        audit, messages = rendered(path, roles, texts)
        counts = np.bincount(found, minlength=4).tolist() if found else [0] * 4
        out.append((
            conv, _gaps([t for t in turns if t is not None]), *counts[1:], _illegal(initials[low:high]), costs[START], audit,
            hashlib.sha256("\n".join(messages).encode("utf-8")).hexdigest(),
        ))
    return pd.DataFrame(out, columns=_NAMES)


# --- conversations of many blocks ----------------------------------------------------------------


def _by_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one (conv_id, block) after the other, from rows that arrive in that order."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        keys = list(zip(frame["conv_id"].tolist(), frame["block"].tolist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if held and keys[low] != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[low:high])
            last = keys[low]
    if held:
        yield pd.concat(held, ignore_index=True)


def _sorted_blocks(df: DataFrame, order: str) -> DataFrame:
    return df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", order)


def _times(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Min-plus product; what is impossible stays so."""
    return np.minimum((one[:, :, None] + two[None, :, :]).min(1), NEVER)


_CLOSURE = np.array([[{q: 0, NEXT[q]: INSERT, NEXT[NEXT[q]]: 2 * INSERT}.get(t, NEVER) for t in range(4)] for q in range(4)], np.int64)
for _q in (USER, ASSISTANT):  # two inserted messages lead back, at a cost
    _CLOSURE[_q, _q] = 0
_ROWS = np.full((4, 4, 4, 4), NEVER, np.int64)
for _i in range(4):
    for _f in range(4):
        for _q in range(4):
            for _, _t, _c in ACTIONS[_i][_f][_q]:
                _ROWS[_i, _f, _q, _t] = min(_ROWS[_i, _f, _q, _t], _c)
_ROWS = np.array([[_times(_CLOSURE, m) for m in row] for row in _ROWS])


def block_matrix(initials: np.ndarray, faults: np.ndarray) -> np.ndarray:
    """Least cost between each state before and after the rows, by halving their number again and again."""
    m = _ROWS[initials, faults]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        one, two = m[0 : len(m) - len(odd) : 2], m[1 : len(m) - len(odd) : 2]
        m = np.concatenate([np.minimum((one[:, :, :, None] + two[:, None, :, :]).min(2), NEVER), odd])
    return m[0]


def _doubled(values: DataFrame, combine, kind: str, blocks: int, ahead: bool) -> DataFrame:
    """``values`` combined over all blocks from each one to the last (ahead) or from the first to each.

    Every round joins a block with the one whose distance is twice that of the round before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            joined = [
                a if b is None or not len(b) else combine(np.asarray(a, np.int64), np.asarray(b, np.int64)).ravel()
                for a, b in zip(frame["value"], frame["other"])
            ]
            yield frame[["conv_id", "block"]].assign(value=joined)

    distance = 1
    while distance < blocks:
        step = -distance if ahead else distance
        other = values.select(F.col("conv_id").alias("of"), (F.col("block") + step).alias("at"), F.col("value").alias("other"))
        on = values["conv_id"].eqNullSafe(other["of"]) & (values["block"] == other["at"])
        paired = values.join(other, on, "left").select("conv_id", "block", "value", "other")
        values = materialize(paired.mapInPandas(run, f"{_KEY}, block long, value array<{kind}>"), "doubled")
        distance *= 2
    return values


def _solve_long(rows: DataFrame) -> DataFrame:
    """Conversations of any length, cut into blocks."""
    # Equal rows are one after the other in any order.
    numbered = rows.withColumns({"one": F.lit(1).cast("long"), "tie": F.monotonically_increasing_id()})
    numbered = running_totals(numbered, [*_order(), F.col("tie")], ["one"], ["conv_id"])
    numbered = numbered.withColumnRenamed("cum_one", "place").drop("one", "total_one", "tie")
    numbered = materialize(numbered.withColumn("block", F.floor((F.col("place") - 1) / BLOCK)), "turns")
    digest = F.sha2("text", 256)
    firsts = numbered.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min("place").alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("first"))
    on = numbered["conv_id"].eqNullSafe(firsts["of"]) & (numbered["place"] == firsts["first"])
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault")).cast("int")
    numbered = materialize(numbered.join(firsts, on, "left").withColumn("fault", fault).drop("of", "first"), "turns")
    slim = numbered.select("conv_id", "block", "place", F.substring("role", 1, 1).alias("role"), "fault")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _by_block(frames):
            m = block_matrix(_initials(own["role"]), own["fault"].to_numpy(np.int64))
            yield own[["conv_id", "block"]].iloc[:1].assign(value=[m.ravel()])

    blocks = numbered.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    values = materialize(_sorted_blocks(slim, "place").mapInPandas(matrices, f"{_KEY}, block long, value array<long>"), "blocks")
    suffixes = _doubled(values, lambda a, b: _times(a.reshape(4, 4), b.reshape(4, 4)), "long", blocks, True)
    behind = suffixes.select(F.col("conv_id").alias("of"), (F.col("block") - 1).alias("at"), "value")

    def with_costs(df: DataFrame) -> DataFrame:
        """``value``: costs from behind a block to the end as a matrix, null behind the last one."""
        return df.join(behind, df["conv_id"].eqNullSafe(behind["of"]) & (df["block"] == behind["at"]), "left").drop("of", "at")

    def costs_after(value) -> tuple[tuple[int, ...], bool]:
        if value is None or not len(value):
            return END, True
        costs = (np.asarray(value, np.int64).reshape(4, 4) + np.array(END)).min(1)
        return tuple(int(min(c, NEVER)) for c in costs), False

    def solved(own: pd.DataFrame) -> Solved:
        after, last = costs_after(own["value"].iloc[0])
        return Solved(_initials(own["role"]), own["fault"].to_numpy(np.int64), np.array([0, len(own)]), [after], [last])

    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _by_block(frames):
            yield own[["conv_id", "block"]].iloc[:1].assign(value=[solved(own).exits()[0]])

    maps = _sorted_blocks(with_costs(slim), "place").mapInPandas(exits, f"{_KEY}, block long, value array<long>")
    entries = _doubled(materialize(maps, "exits"), lambda a, b: a[b], "long", blocks, False)
    entries = entries.select(F.col("conv_id").alias("of"), (F.col("block") + 1).alias("at"), F.element_at("value", START + 1).alias("entry"))
    whole = with_costs(numbered.withColumn("turn", F.col("turn").cast("string")))
    whole = whole.join(entries, whole["conv_id"].eqNullSafe(entries["of"]) & (whole["block"] == entries["at"]), "left").drop("of", "at")

    parts_schema = (
        f"{_KEY}, block long, blank long, duplicate long, truncated long, illegal long, cost long, first int, last int, "
        "low string, high string, turns long, audit string, messages array<string>"
    )

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _by_block(frames):
            result, entry = solved(own), own["entry"].iloc[0]
            entry = START if pd.isna(entry) else int(entry)
            audit, messages = rendered(result.paths(np.array([entry]))[0], own["role"].tolist(), own["text"].tolist())
            initials, turns = _initials(own["role"]), [int(t) for t in own["turn"].dropna()]
            counts = np.bincount(own["fault"].to_numpy(np.int64), minlength=4).tolist()
            yield pd.DataFrame([(
                own["conv_id"].iloc[0], int(own["block"].iloc[0]), *counts[1:], _illegal(initials), result.costs[0][START], int(initials[0]),
                int(initials[-1]), str(min(turns)) if turns else None, str(max(turns)) if turns else None, len(set(turns)), audit, messages,
            )], columns=[c.split()[0] for c in parts_schema.split(", ")])

    pieces = materialize(_sorted_blocks(whole, "place").mapInPandas(parts, parts_schema), "pieces")

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for frame in frames:
            for p in frame.itertuples(index=False):
                conv = p.conv_id
                if state is not None and state.conv != conv:
                    yield state.row()
                    state = None
                state = state or _Joined(conv)
                state.add(p)
        if state is not None:
            yield state.row()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(joined, _RESULT)


class _Joined:
    """The result of one long conversation, from its blocks in order."""

    def __init__(self, conv):
        self.conv, self.counts, self.illegal, self.cost, self.turns = conv, [0, 0, 0], 0, None, 0
        self.low = self.high = self.last = None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, part) -> None:
        self.counts = [a + b for a, b in zip(self.counts, (part.blank, part.duplicate, part.truncated))]
        self.cost = part.cost if self.cost is None else self.cost
        self.illegal += part.illegal + (0 if self.last is None else _illegal(np.array([self.last, part.first])))
        self.last = part.last
        low, high = _int(part.low), _int(part.high)
        if low is not None:
            # A turn may go on from the block before, but then counts once.
            self.turns += part.turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        self.audit.append(part.audit)
        for message in part.messages:
            self.hash.update((("\n" if self.begun else "") + message).encode("utf-8"))
            self.begun = True

    def row(self) -> pd.DataFrame:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        out = (self.conv, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
        return pd.DataFrame([out], columns=_NAMES)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, present): faults, cost, audit and digest."""
    rows = _marked(rows).withColumn("conv_id", F.col("conv_id").cast("string"))
    sizes = rows.groupBy("conv_id").agg(F.count_if("present").alias("n"))
    long = broadcast_if_small(materialize(sizes.where(F.col("n") > BLOCK).select(F.col("conv_id").alias("of")), "long"))
    of = rows["conv_id"].eqNullSafe(long["of"])
    short = rows.join(long, of, "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    found = short.withColumn("turn", F.col("turn").cast("string")).mapInPandas(_solve_short, _RESULT)
    if long.head(1):
        found = found.unionByName(_solve_long(rows.join(long, of, "left_semi").where("present").drop("present")))
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
