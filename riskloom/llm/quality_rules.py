"""Quality rules: gradient-boosted trees over statistics of a document.

Two fixed rules come first (too few words, too much repetition); what passes them is
judged by boosted trees with logistic loss, fitted in numpy on a bounded sample of
labelled rows. Chosen features are monotonic: more symbols, repetition or repeated lines
can never raise the score. All trees are flattened into node arrays, and a batch of
documents walks down every tree at once.

Defined results: a null or empty text has no words, so it fails the fixed rules; repeated
rows get equal verdicts; without usable labels the trees judge nothing and the fixed rules
decide alone; other columns are carried along by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import text as T
from riskloom.llm.training import SAMPLE_ROWS, held_out, labelled_texts

MIN_WORDS = 50
THRESHOLD = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?'\"()-")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature, and the direction the score may move in as it grows (0: any).
FEATURES = {
    "log_words": 0, "chars_per_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "twin_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": 0, "distinct_share": 0, "words_per_line": 0,
}


def _again(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of texts: a sort by (text, hash), and which sorted items equal the one before."""
    order = np.lexsort((hashes, owners))
    o, h = owners[order], hashes[order]
    same = np.zeros(len(order), bool)
    same[1:] = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    return order, same


def statistics(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The five counts (n x 5) and the model's features (n x 11) of a slice's texts."""
    n, data, at = len(part), part.data, part.offsets
    words = T.split_words(part)
    hashes = T.range_hashes(data, words.starts, words.ends)
    heads = (data & 0xC0) != 0x80
    inside = ~T.SPACE[data]
    n_words = words.counts
    word_chars = T.per_text(heads & inside, at)
    n_symbols = T.per_text(SYMBOLS[data], at)

    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], newline + 1]))
    owners = np.sort(np.concatenate([np.arange(n), part.owner_of(newline)]))
    ends = np.append(starts[1:], len(data))
    last = np.append(owners[1:] != owners[:-1], True) if n else np.empty(0, bool)
    ends = np.where(last, at[owners + 1], ends - 1)
    filled = np.concatenate([[0], np.cumsum(inside)])
    spoken = np.flatnonzero(filled[ends] > filled[starts])
    order, same = _again(owners[spoken], T.range_hashes(data, starts[spoken], ends[spoken]))
    n_dup = np.bincount(owners[spoken][order[same]], minlength=n)
    n_lines = np.bincount(owners[spoken], minlength=n)

    triples, first = T.windows(hashes, words.bounds, 3)
    order, same = _again(words.owners[first], triples)
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[first[order[twice]] + k] = True
    n_repeat = T.per_text(covered, words.bounds)

    twins = np.zeros(len(words), bool)
    twins[1:] = (hashes[1:] == hashes[:-1]) & (words.owners[1:] == words.owners[:-1])
    order, same = _again(words.owners, hashes)
    n_distinct = n_words - np.bincount(words.owners[order[same]], minlength=n)

    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack([
        np.log1p(n_words), word_chars / w, n_symbols / c, n_dup / np.maximum(n_lines, 1), n_repeat / w,
        T.per_text(twins, words.bounds) / w, T.per_text(_UPPER[data], at) / c, T.per_text(_DIGIT[data], at) / c,
        T.per_text(_MARKS[data], at) / c, n_distinct / w, n_words / np.maximum(n_lines, 1),
    ], 1)
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: under 50 words, or over half of the words repeated."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class BoostedTrees:
    """Node arrays of all trees. A leaf points at itself, so every walk has ``depth`` steps."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good class for each row of features."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        total = self.base + self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _best_split(g, h, codes, n_bins, directions, low, high, ridge, min_rows):
    """Feature, bin and the two leaf values of the best allowed split of some rows."""
    best = (1e-6, None)
    total_g, total_h = g.sum(), h.sum()
    parent = total_g**2 / (total_h + ridge)
    for f, bins in enumerate(n_bins):
        if bins < 2:
            continue
        sg = np.cumsum(np.bincount(codes[:, f], g, bins))[:-1]
        sh = np.cumsum(np.bincount(codes[:, f], h, bins))[:-1]
        sn = np.cumsum(np.bincount(codes[:, f], minlength=bins))[:-1]
        lv = np.clip(-sg / (sh + ridge), low, high)
        rv = np.clip(-(total_g - sg) / (total_h - sh + ridge), low, high)
        ok = (sn >= min_rows) & (len(g) - sn >= min_rows) & (directions[f] * (rv - lv) >= 0)
        gain = np.where(ok, sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - parent, -1.0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (f, k, lv[k], rv[k]))
    return best[1]


def train(
    x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 80, depth: int = 3, rate: float = 0.2,
    bins: int = 64, ridge: float = 2.0, min_rows: int = 8,
) -> BoostedTrees | None:
    """Fit boosted trees; None if there is nothing to tell apart."""
    if len(np.unique(y)) < 2:
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    n_bins = [len(c) + 1 for c in cuts]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("cut", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    def grow(rows, level, low, high, value) -> int:
        at = add(rate * value)
        split = level < depth and _best_split(g[rows], h[rows], codes[rows], n_bins, directions, low, high, ridge, min_rows)
        if split:
            f, k, lv, rv = split
            goes_left = codes[rows, f] <= k
            # Children of a monotonic split may not cross the middle of its two values.
            middle = (lv + rv) / 2
            bounds = [(low, high), (low, high)]
            if directions[f]:
                bounds = [(low, middle), (middle, high)] if directions[f] > 0 else [(middle, high), (low, middle)]
            nodes["feature"][at], nodes["cut"][at] = f, float(cuts[f][k])
            nodes["left"][at] = grow(rows[goes_left], level + 1, *bounds[0], lv)
            nodes["right"][at] = grow(rows[~goes_left], level + 1, *bounds[1], rv)
        else:
            total[rows] += rate * value
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        start = float(np.clip(-g.sum() / (h.sum() + ridge), -4, 4))
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0, start))
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return BoostedTrees(**arrays, roots=np.array(roots), depth=depth, base=base)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch.column("text")):
            counts, features = statistics(part)
            some = pa.array(~base_failed(counts))
            size = len(part)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(part.first, size).filter(some),
                batch.column("label").slice(part.first, size).filter(some),
                pa.array(features.tolist(), pa.list_(pa.float64())).filter(some),
            ], names=["doc_id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> BoostedTrees | None:
    """Train on at most ``rows`` labelled documents that pass the fixed rules, outside the held-out fold."""
    sample = labelled_texts(docs, labels, "quality", rows, ~held_out())
    found = sample.mapInArrow(_training_rows, "doc_id long, label int, features array<double>").toArrow()
    parsed = sorted(found.to_pylist(), key=lambda r: r["doc_id"])
    if not parsed:
        return None
    x, y = np.array([r["features"] for r in parsed]), np.array([float(r["label"] > 0) for r in parsed])
    del found, parsed
    model = train(x, y, list(FEATURES.values()))
    T.give_back()
    return model


def judge(column: pa.Array, model: BoostedTrees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, failures of the fixed rules, scores and verdicts for a column of texts."""
    counts, scores = [np.empty((0, 5), np.int64)], [np.empty(0)]
    for part in T.slices(column):
        c, x = statistics(part)
        counts.append(c)
        scores.append(model.score(x) if model else np.ones(len(part)))
    c, s = np.concatenate(counts), np.concatenate(scores)
    failed = base_failed(c)
    return c, failed, s, ~failed & (s >= THRESHOLD)


def measure(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """Every document's id, counts, fixed-rule failure, score and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, score, kept = judge(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(score),
                 pa.array(kept)],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """The documents that fixed rules and trees both accept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column("text"), model)[3]))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
