"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, user
first, and does not end with the system message. Every turn may be kept (free), relabelled,
merged into the message before it, or preceded by an empty message that makes it legal; each
repair has a cost, and dynamic programming over the automaton's states (the role of the last
message) finds the cheapest choice for all turns together.

A turn is a 4 x 4 matrix of costs between states, and such matrices combine by sums and
minima in any grouping. So a conversation of any length is cut into chunks of bounded
length: chunks are combined in levels, the best states are handed back down, and every chunk
then finds its own path between its two states.

The result has one row for each turn or inserted message. Concatenated in order of ``place``
and ``part`` the ``rendered`` strings of a conversation are its chat text.

Defined results: turns go by number, missing numbers last, then by role and text; repeated
rows are turns of their own; a null text is an empty one; a null or unknown role may take any
role at a small cost; rows without a conversation id form one conversation; markers inside a
text are broken up by a space; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.ordering import running_totals
from riskloom.session import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: Names that mean a role.
ALIASES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT,
}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, UNKNOWN, MERGE, INSERT = 3.0, 1.0, 1.0, 2.0
#: Turns of a chunk, and chunks combined into one of the next level.
CHUNK = 512
Option = tuple[float, str, int]  # cost, action, inserted role


def role_of(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), START)


def _as(role: int, wanted: int) -> float:
    return 0.0 if role == wanted else UNKNOWN if role == START else RELABEL


def turn_options(role: int) -> dict[tuple[int, int], Option]:
    """The cheapest way from each state to each state over a turn of this role."""
    found: dict[tuple[int, int], Option] = {}
    for state, nexts in LEGAL.items():
        ways = [(_as(role, q), "keep" if q == role else "relabel", START, q) for q in nexts]
        if state != START:
            ways.append((MERGE + _as(role, state), "merge", START, state))
        ways += [
            (INSERT + _as(role, q), "keep" if q == role else "relabel", p, q) for p in nexts if p != SYSTEM for q in LEGAL[p]
        ]
        for cost, action, inserted, q in ways:
            if (state, q) not in found or cost < found[state, q][0]:
                found[state, q] = (cost, action, inserted)
    return found


OPTIONS = [turn_options(role) for role in range(4)]
MATRICES = np.full((4, 4, 4), np.inf)
for _role, _found in enumerate(OPTIONS):
    for (_a, _b), _option in _found.items():
        MATRICES[_role, _a, _b] = _option[0]
#: Cost of ending in a state; after a system message an empty user message is added.
END = np.array([0.0, INSERT, 0.0, 0.0])


def combine(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one[:, :, None] + two[None, :, :]).min(1)


def best_path(matrices: np.ndarray, entry: int, last: int | None) -> list[int]:
    """States after each matrix on the cheapest way from ``entry`` to ``last`` (or to the cheapest end)."""
    cost = np.full(4, np.inf)
    cost[entry] = 0
    back = np.empty((len(matrices), 4), np.int64)
    for k, m in enumerate(matrices):
        total = cost[:, None] + m
        back[k] = total.argmin(0)
        cost = total.min(0)
    state = int((cost + END).argmin()) if last is None else last
    out = [state]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(int(back[k][out[-1]]))
    return out[::-1]


_MATRIX = "array<double>"


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Complete groups of rows that arrive sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        key = [tuple(None if pd.isna(x) else x for x in row) for row in frame[keys].itertuples(index=False)]
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for low, high in zip(cuts, cuts[1:]):
            if held and key[low] != last:
                yield pd.concat(held)
                held = []
            held.append(frame.iloc[low:high])
            last = key[low]
    if held:
        yield pd.concat(held)


def _sorted_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def _leaf_matrices(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, matrix) of the chunks of long conversations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["conv_id", "chunk"]):
            total = None
            for role in group["role"]:
                m = MATRICES[role_of(role)]
                total = m if total is None else combine(total, m)
            yield group.iloc[:1][["conv_id", "chunk"]].assign(matrix=[total.ravel()])

    rows = _sorted_groups(turns.select("conv_id", "chunk", "place", "role"), ["conv_id", "chunk"], "place")
    return rows.mapInPandas(run, f"conv_id long, chunk long, matrix {_MATRIX}")


def _raise_level(level: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["conv_id", "above"]):
            total = None
            for m in group["matrix"]:
                m = np.asarray(m).reshape(4, 4)
                total = m if total is None else combine(total, m)
            yield pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "chunk": group["above"].iloc[:1], "matrix": [total.ravel()]})

    rows = level.withColumn("above", F.floor(F.col("chunk") / CHUNK))
    return _sorted_groups(rows, ["conv_id", "above"], "chunk").mapInPandas(run, level.schema)


def _lower_level(level: DataFrame, states: DataFrame) -> DataFrame:
    """States before and after each chunk of a level, from those of the level above."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["conv_id", "above"]):
            matrices = np.array([np.asarray(m).reshape(4, 4) for m in group["matrix"]])
            entry, last = int(group["entry"].iloc[0]), int(group["last"].iloc[0])
            after = best_path(matrices, entry, last)
            yield group[["conv_id", "chunk"]].assign(entry=[entry, *after[:-1]], last=after)

    up = states.select(F.col("conv_id").alias("of"), F.col("chunk").alias("above"), "entry", "last")
    rows = level.withColumn("above", F.floor(F.col("chunk") / CHUNK)).alias("l").join(
        up.alias("u"), F.col("l.conv_id").eqNullSafe(F.col("u.of")) & (F.col("l.above") == F.col("u.above"))
    ).select("conv_id", "chunk", "matrix", F.col("l.above").alias("above"), "entry", "last")
    return _sorted_groups(rows, ["conv_id", "above"], "chunk").mapInPandas(run, "conv_id long, chunk long, entry int, last int")


def _chunk_states(turns: DataFrame, longest: int) -> DataFrame:
    levels = [materialize(_leaf_matrices(turns), "chunks")]
    chunks = -(-longest // CHUNK)
    while chunks > 1:
        levels.append(materialize(_raise_level(levels[-1]), "chunks"))
        chunks = -(-chunks // CHUNK)

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            last = [int((np.asarray(m).reshape(4, 4)[START] + END).argmin()) for m in frame["matrix"]]
            yield frame[["conv_id", "chunk"]].assign(entry=START, last=last)

    states = levels[-1].mapInPandas(top, "conv_id long, chunk long, entry int, last int")
    for level in levels[-2::-1]:
        states = materialize(_lower_level(level, states), "states")
    return states


def _broken(text: str | None) -> str:
    return (text or "").replace("<|", "< |").replace("|>", "| >")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per turn or inserted message: conv_id, place, part, role, action, cost, text, rendered."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last(), F.col("tie")]
    turns = running_totals(turns, order, ["one"], ["conv_id"])
    turns = turns.select("conv_id", "role", "text", F.col("cum_one").alias("place"), F.col("total_one").alias("turns"))
    turns = materialize(turns.withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK)), "turns")
    longest = turns.agg(F.coalesce(F.max("turns"), F.lit(0))).first()[0]
    if longest > CHUNK:
        states = _chunk_states(turns.where(F.col("turns") > CHUNK), longest)
        states = states.select(F.col("conv_id").alias("of"), F.col("chunk").alias("at"), "entry", "last")
        turns = turns.join(states, turns["conv_id"].eqNullSafe(states["of"]) & (turns["chunk"] == states["at"]), "left").drop("of", "at")
    else:
        turns = turns.withColumn("entry", F.lit(None).cast("int")).withColumn("last", F.lit(None).cast("int"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _groups(frames, ["conv_id", "chunk"]):
            roles = [role_of(r) for r in group["role"]]
            entry, last = group["entry"].iloc[0], group["last"].iloc[0]
            state, fixed = (START, None) if pd.isna(entry) else (int(entry), int(last))
            conv = None if pd.isna(group["conv_id"].iloc[0]) else int(group["conv_id"].iloc[0])
            after = best_path(MATRICES[roles], state, fixed)
            for role, text, place, turns_, new in zip(roles, group["text"], group["place"], group["turns"], after):
                cost, action, inserted = OPTIONS[role][state, new]
                text, close = _broken(text), "" if state == START else "<|im_end|>\n"
                if inserted:
                    out.append((conv, place, 0, ROLES[inserted], "insert", INSERT, "", f"{close}<|im_start|>{ROLES[inserted]}\n"))
                    cost, close = cost - INSERT, "<|im_end|>\n"
                opening = "\n" if action == "merge" else f"{close}<|im_start|>{ROLES[new]}\n"
                ending = "<|im_end|>\n" if place == turns_ and new != SYSTEM else ""
                out.append((conv, place, 1, ROLES[new], action, cost, text, opening + text + ending))
                if place == turns_ and new == SYSTEM:
                    out.append((conv, place, 2, "user", "insert", INSERT, "", "<|im_end|>\n<|im_start|>user\n<|im_end|>\n"))
                state = new
            if len(out) > 5_000:
                yield _frame(out)
                out = []
        yield _frame(out)

    rows = _sorted_groups(turns, ["conv_id", "chunk"], "place")
    return rows.mapInPandas(run, "conv_id long, place long, part int, role string, action string, cost double, text string, rendered string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "place", "part", "role", "action", "cost", "text", "rendered"])
    return frame.astype({"conv_id": "Int64"})


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
