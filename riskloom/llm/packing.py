"""Packing token sequences: cutting stock by column generation.

Every document becomes full sequences of ``length`` tokens and one remainder. Remainders
are counted by length, in steps of ``STEP`` tokens, and that histogram (at most
length / STEP bins, whatever the corpus) is all the driver sees. A linear program over
patterns (how many remainders of each bin share a sequence) is solved by column
generation: a simplex step over the current patterns gives every bin a price, and a
knapsack dynamic program finds the pattern worth most. Rounded down, pattern counts are
dealt to documents by their rank within the bin. The few remainders left over by rounding
are laid end to end and cut where a sequence is full; what is left at the end is cut into
powers of two, which need no padding.

Short remainders are first laid end to end in bundles, so that rounding their lengths
costs little. Ranks within a bin come from counts of hashed sub-groups of bounded size, so a length
that a third of all documents share is still numbered by many tasks.

Defined results: a null or empty text is one token, the closing one; repeated rows are
packed separately; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskloom.llm import text as T
from riskloom.llm.tokens import UnitEncoder
from riskloom.operators.ordering import running_totals
from riskloom.session import materialize

LENGTH = 2048
#: Remainders are packed as if rounded up to a multiple of this many tokens.
STEP = 8
CLOSING_ID = 1
#: Pieces of at most so many tokens are bundled up to about this many first.
SHORT, BUNDLE = 64, 480
#: Rows per sub-group when ranks are counted.
GROUP_ROWS = 1_000
VOCABULARY_FILE = "word_bpe_49k.json"

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


class WordTokens:
    """Ids of whole texts by a word tokenizer that lower-cases and drops white space."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # The strings of added tokens are found before a text is normalised and become their
        # ids. They are cut out here; in what lies between, such a string is ordinary text.
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that depend on the text around them are not supported")
        self.added = {t.content.encode("utf-8"): id_ for id_, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest_first))) if self.added else None
        self.tokenizer.encode_special_tokens = True
        self.units = UnitEncoder(self._encode_units)

    def _encode_units(self, units: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([u.decode("utf-8") for u in units], add_special_tokens=False)
        return [e.ids for e in found]

    def _added_tokens(self, part: T.Slice) -> list[tuple[int, int, int]]:
        """Start, end and id of the added tokens' strings in a slice's texts."""
        if self.pattern is None:
            return []
        raw = part.data.tobytes()
        if not self.pattern.search(raw):
            return []
        bounds = part.offsets.tolist()
        return [
            (m.start(), m.end(), self.added[m.group()])
            for low, high in zip(bounds, bounds[1:]) for m in self.pattern.finditer(raw, low, high)
        ]

    def encode(self, part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts in one array, and n + 1 bounds by text.

        Words are also cut between an ASCII letter and ASCII punctuation other than the
        apostrophe: the tokenizer always separates those two.
        """
        added, data = self._added_tokens(part), part.data
        if added:
            data = data.copy()
            for low, high, _ in added:
                data[low:high] = 32
        words = T.split_words(T.Slice(part.first, part.last, data, part.offsets), _BLANK)
        before, after = data[:-1], data[1:]
        inner = np.flatnonzero((_LETTER[before] & _PUNCTUATION[after]) | (_PUNCTUATION[before] & _LETTER[after])) + 1
        inner = inner[~np.isin(inner, part.offsets)]
        starts = np.sort(np.concatenate([words.starts, inner]))
        ends = np.sort(np.concatenate([words.ends, inner]))
        ids, bounds = self.units(T.LOWER[data], starts, ends)
        by_text = bounds[np.searchsorted(starts, part.offsets)]
        if added:
            places = np.array([low for low, _, _ in added])
            ids = np.insert(ids, bounds[np.searchsorted(starts, places)], [id_ for _, _, id_ in added])
            by_text = by_text + np.searchsorted(places, part.offsets)
        return ids, by_text


@lru_cache(maxsize=2)
def _worker_tokens(definition: str) -> WordTokens:
    return WordTokens(definition)


def closed_ids(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by the closing id."""
    out = np.insert(ids, bounds[1:], CLOSING_ID).astype("<u4")
    return out, bounds + np.arange(len(bounds))


def _cut(docs: DataFrame, definition, length: int) -> DataFrame:
    """Full pieces and remainders of every document, with their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(definition.value)
        for batch in batches:
            for part in T.slices(batch.column("text")):
                ids, bounds = closed_ids(*tokens.encode(part))
                sizes = np.diff(bounds)
                pieces = -(-sizes // length)
                owner = np.repeat(np.arange(len(part)), pieces)
                start = T.ragged(np.zeros(len(part), np.int64), pieces) * length
                size = np.minimum(sizes[owner] - start, length)
                raw, low = ids.tobytes(), bounds[owner] + start
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(low.tolist(), size.tolist())]
                rows = pa.array(owner + part.first)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(rows), "text_key": batch.column("text_key").take(rows),
                    "doc_tokens": pa.array(sizes[owner], pa.int64()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                })

    schema = "doc_id long, text_key long, doc_tokens long, start long, length long, ids_crc32 long"
    return docs.mapInArrow(run, schema)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits: an unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    s, v = sizes[useful], values[useful]
    order = np.argsort(s, kind="stable")
    s, v, useful = s[order], v[order], useful[order]
    for room in range(1, capacity + 1):
        best[room], fits = best[room - 1], np.searchsorted(s, room, side="right")
        if fits:
            worth = best[room - s[:fits]] + v[:fits]
            k = int(np.argmax(worth))
            if worth[k] > best[room] + 1e-12:
                best[room], taken[room] = worth[k], k
    pattern, room = np.zeros(len(values), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[useful[taken[room]]] += 1
            room -= int(s[taken[room]])
    return float(best[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, minimising the number of sequences.

    Simplex with columns generated on demand, from the patterns that repeat one size. If
    the best pattern is worth w sequences, no solution uses fewer than 1 / w of the present
    number, so it ends when w shows that at most ``gap`` can still be saved. ``steps`` only
    guards against endless cycling; the solution is a valid one after every step.
    """
    if not len(sizes):
        return np.empty((0, 0), np.int64), np.empty(0)
    patterns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = demand / np.diag(patterns)
    for _ in range(steps):
        worth, pattern = best_pattern(np.ones(len(sizes)) @ inverse, sizes, capacity)
        if worth <= 1 + gap:
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        used = used - ratio[out] * change
        used[out] = ratio[out]
        inverse[out] /= change[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(change[others], inverse[out])
        patterns[out] = pattern
        used = np.maximum(used, 0)
    return patterns, used


@dataclass
class Plan:
    """For each bin, consecutive ranks and the sequences they go to."""

    first_rank: dict[int, np.ndarray]
    per_sequence: dict[int, np.ndarray]
    first_sequence: dict[int, np.ndarray]
    dealt: dict[int, int]
    sequences: int

    def sequence(self, bin_: int, ranks: np.ndarray) -> np.ndarray:
        """Sequence numbers of ranks of one bin; -1 for those that rounding left over."""
        if bin_ not in self.first_rank:
            return np.full(len(ranks), -1, np.int64)
        k = np.searchsorted(self.first_rank[bin_], ranks, side="right") - 1
        found = self.first_sequence[bin_][k] + (ranks - self.first_rank[bin_][k]) // self.per_sequence[bin_][k]
        return np.where(ranks < self.dealt[bin_], found, -1)


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Deal the counted pieces of each bin to sequences; bin ``capacity`` fills one alone."""
    sizes = np.array(sorted(b for b in histogram if b < capacity), np.int64)
    demand = np.array([histogram[b] for b in sizes.tolist()], float)
    patterns, used = solve_patterns(sizes, demand, capacity)
    rounded = np.floor(used + 1e-6).astype(np.int64)
    entries: dict[int, list[tuple[int, int, int]]] = {}
    dealt: dict[int, int] = {}
    sequence = 0
    if histogram.get(capacity):
        entries[capacity], dealt[capacity], sequence = [(0, 1, 0)], histogram[capacity], histogram[capacity]
    for pattern, times in zip(patterns, rounded.tolist()):
        # Rounding noise could ask for a piece too many; such a pattern is used less often.
        for k in np.flatnonzero(pattern):
            times = min(times, int(demand[k] - dealt.get(int(sizes[k]), 0)) // int(pattern[k]))
        if times <= 0:
            continue
        for k in np.flatnonzero(pattern):
            b, each = int(sizes[k]), int(pattern[k])
            entries.setdefault(b, []).append((dealt.get(b, 0), each, sequence))
            dealt[b] = dealt.get(b, 0) + each * times
        sequence += times
    columns = [{b: np.array([e[i] for e in v], np.int64) for b, v in entries.items()} for i in range(3)]
    return Plan(*columns, dealt, sequence)


def cut_points(total: int, length: int) -> np.ndarray:
    """Starts of sequences for tokens laid end to end: full ones, then falling powers of two."""
    full, rest = divmod(total, length)
    points = [k * length for k in range(full + 1)]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            points.append(points[-1] + (1 << bit))
    return np.array(points if rest == 0 else points[:-1], np.int64)[: full + bin(rest).count("1")]


def _lay_out(rows: pd.DataFrame, first: int, length: int) -> pd.DataFrame:
    """Cut left-over pieces, laid end to end, at the ends of sequences."""
    ends = rows["length"].cumsum().to_numpy()
    starts = ends - rows["length"].to_numpy()
    points = cut_points(int(ends[-1]) if len(ends) else 0, length)
    low, high = np.searchsorted(points, starts, side="right") - 1, np.searchsorted(points, ends, side="left")
    count = high - low
    at = np.repeat(np.arange(len(rows)), count)
    seq = T.ragged(low, count)
    begin = np.maximum(starts[at], points[seq]) if len(at) else at
    end = np.minimum(ends[at], np.append(points[1:], ends[-1])[seq]) if len(at) else at
    out = rows.iloc[at].copy()
    out["whole"] = count[at] == 1
    out["start"] = out["start"].to_numpy() + begin - starts[at]
    out["length"] = end - begin
    out["sequence_id"] = first + seq
    out["offset"] = begin - points[seq] if len(at) else at
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """One row per piece: where it comes from and where in which sequence it lies."""
    spark = docs.sparkSession
    with open(path or public_tokenizers.path(VOCABULARY_FILE), encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())  # its size follows the vocabulary
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    items = materialize(_items(materialize(_cut(texts, definition, length), "pieces"), step), "items")

    histogram = {r["bin"]: r["n"] for r in items.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, -(-length // step))

    # Ranks: number the rows of small hashed groups, after the rows of the groups before them.
    groups = {b: -(-n // GROUP_ROWS) for b, n in histogram.items()}
    spread = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)) if groups else F.create_map(F.lit(0), F.lit(1))
    items = items.withColumn("part", F.pmod(F.xxhash64("members"), spread[F.col("bin")].cast("long")))
    sizes = items.groupBy("bin", "part").agg(F.count("*").alias("n"))
    sizes = running_totals(sizes, [F.col("part")], ["n"], ["bin"]).select("bin", "part", (F.col("cum_n") - F.col("n")).alias("before"))
    within = Window.partitionBy("bin", "part").orderBy("members")
    ranked = (
        items.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["bin", "part"])
        .select("members", "size", "bin", (F.col("rank") + F.col("before")).alias("rank"))
    )

    @F.pandas_udf("long")
    def sequence_of(bins: pd.Series, ranks: pd.Series) -> pd.Series:
        out, bins, ranks = np.full(len(bins), -1, np.int64), bins.to_numpy(), ranks.to_numpy()
        for b in np.unique(bins):
            at = np.flatnonzero(bins == b)
            out[at] = plan.sequence(int(b), ranks[at])
        return pd.Series(out)

    dealt = materialize(ranked.withColumn("sequence_id", sequence_of("bin", "rank")), "dealt")

    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = (
        dealt.where("sequence_id >= 0").withColumn("at", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .select("sequence_id", "at", F.explode("members").alias("m"))
        .select("m.*", "sequence_id", (F.col("at") + F.col("m.lead")).alias("offset")).select(names)
    )

    # Rounding leaves less than one sequence for each pattern, of at most length / step patterns.
    rest = dealt.where("sequence_id < 0").select("bin", "rank", F.explode("members").alias("m")).select("bin", "rank", "m.*")
    rest = rest.orderBy(F.desc("bin"), "rank", "lead").toPandas()
    if not len(rest):
        return placed
    rest["doc_id"] = rest["doc_id"].astype("Int64")
    laid = _lay_out(rest, plan.sequences, length)
    columns = ["doc_id", "text_key", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "whole"]
    schema = ", ".join(f"{c} {'boolean' if c == 'whole' else 'long'}" for c in columns)
    rows = [tuple(None if pd.isna(v) else (bool(v) if c == "whole" else int(v)) for c, v in zip(columns, r)) for r in laid[columns].itertuples(index=False)]
    laid = spark.createDataFrame(rows, schema)
    cut = _checksums(texts, laid.where("not whole").drop("ids_crc32", "whole"), definition)
    return placed.unionByName(laid.where("whole").select(names)).unionByName(cut.select(names))


def _items(pieces: DataFrame, step: int) -> DataFrame:
    """What is packed: long pieces alone, short ones laid end to end in bundles.

    Rounding up to ``step`` would waste much of a short piece, but little of a bundle.
    """
    member = [c for c in pieces.columns]
    short = F.col("length") <= SHORT
    n_short = pieces.where(short).count()
    alone = pieces.where(~short).select(
        F.array(F.struct(F.lit(0).cast("long").alias("lead"), *member)).alias("members"), F.col("length").alias("size")
    )
    parts = max(1, -(-n_short // GROUP_ROWS))
    ahead = Window.partitionBy("part").orderBy(*member).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        pieces.where(short).withColumn("part", F.pmod(F.xxhash64(*member), F.lit(parts)))
        .withColumn("before", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
        .withColumn("bundle", F.floor(F.col("before") / BUNDLE))
    )
    bundles = placed.groupBy("part", "bundle").agg(
        F.sum("length").alias("size"), F.min("before").alias("first"),
        F.sort_array(F.collect_list(F.struct(F.col("before").alias("lead"), *member))).alias("members"),
    )
    shifted = F.transform("members", lambda m: m.withField("lead", m["lead"] - F.col("first")))
    both = alone.unionByName(bundles.select(shifted.alias("members"), "size"))
    return both.withColumn("bin", F.ceil(F.col("size") / step).cast("int"))


def _checksums(texts: DataFrame, cut: DataFrame, definition) -> DataFrame:
    """Checksums of the pieces of ``cut``, of which there are a few for each bin at most."""
    wanted = cut.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset", "doc_tokens")).alias("parts")
    )
    on = texts["doc_id"].eqNullSafe(F.col("w.doc_id")) & (texts["text_key"] == F.col("w.text_key"))
    # The broadcast side is the left-over of rounding, bounded by the number of bins.
    found = texts.join(F.broadcast(wanted.alias("w")), on).select(texts["doc_id"], texts["text_key"], "text", "parts")
    found = found.groupBy("doc_id", "text_key").agg(F.min("text").alias("text"), F.first("parts").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(definition.value)
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            for part in T.slices(batch.column("text")):
                ids, bounds = closed_ids(*tokens.encode(part))
                out = []
                for k in range(len(part)):
                    own, doc_id = ids[bounds[k] : bounds[k + 1]], batch.column("doc_id")[part.first + k].as_py()
                    for p in parts[part.first + k]:
                        out.append({"doc_id": doc_id, **p, "ids_crc32": zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    return found.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
