"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors, one for each hashed word, each hashed pair of
neighbouring words and each hashed run of three bytes (upper and lower case kept, white
space as a border). A pair is hashed by the difference of its words' codes, so that all
words said twice in a row share one vector. A softmax layer over that
mean gives the class. Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. As the layer is linear, every
vector is reduced to one number before scoring: a document's score is the logistic
function of the mean of its features' numbers.

Defined results: a null or empty text has no features and gets the share of good rows in
the training sample; repeated rows get equal scores; a table without usable labels gives
0.5 everywhere; other columns of the tables are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import text as T
from riskloom.llm.training import SAMPLE_ROWS, held_out, labelled_texts

BUCKET_BITS = 17
RUN_BUCKETS = 1 << (BUCKET_BITS - 1)
WORD_BUCKETS = 1 << (BUCKET_BITS - 2)
THRESHOLD = 0.3
_SEEN = T.SPACE * np.uint8(32) + ~T.SPACE * np.arange(256, dtype=np.uint8)


def features(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a slice, text after text, and n + 1 bounds by text.

    Words use the first quarter of the buckets, pairs the second, byte runs the rest. The
    first word of a text stands for a pair of its own.
    """
    words = T.split_words(part)
    hashed = T.range_hashes(part.data, words.starts, words.ends)
    pairs = hashed.copy()
    pairs[1:] -= np.where(words.owners[1:] == words.owners[:-1], hashed[:-1], np.uint64(0))
    word_buckets = np.empty(2 * len(words), np.int32)
    word_buckets[::2] = hashed >> np.uint64(66 - BUCKET_BITS)
    word_buckets[1::2] = (T.mix(pairs) >> np.uint64(66 - BUCKET_BITS)).astype(np.int32) + WORD_BUCKETS
    seen = _SEEN[part.data].astype(np.uint32)
    if len(seen) >= 3:
        runs = seen[:-2] * np.uint32(0x9E3779B1) + seen[1:-1] * np.uint32(0x85EBCA6B) + seen[2:] * np.uint32(0xC2B2AE35)
        usable = seen[1:-1] != 32
        for stop in part.offsets[1:-1]:
            usable[max(0, stop - 2) : stop] = False
        at = np.flatnonzero(usable)
        runs = ((runs[at] ^ (runs[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - BUCKET_BITS)
        run_buckets = runs.astype(np.int32) + RUN_BUCKETS
    else:
        at, run_buckets = np.empty(0, np.int64), np.empty(0, np.int32)
    run_bounds = np.searchsorted(at, part.offsets)
    bounds = 2 * words.bounds + run_bounds
    merged = np.empty(len(word_buckets) + len(run_buckets), np.int32)
    owners = np.repeat(words.owners, 2)
    merged[np.arange(len(word_buckets)) + run_bounds[owners]] = word_buckets
    owners = part.owner_of(at)
    merged[np.arange(len(at)) + 2 * words.bounds[owners + 1]] = run_buckets
    return merged, bounds


@dataclass
class SubwordClassifier:
    """One number per bucket, and the share of good rows for texts without features."""

    logits: np.ndarray
    bias: float
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of the good class for each text of a column."""
        out = [np.empty(0)]
        for part in T.slices(column):
            buckets, bounds = features(part)
            sums = np.concatenate([[0.0], np.cumsum(self.logits[buckets], dtype=np.float64)])
            n = np.diff(bounds)
            mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
            out.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40))), self.prior))
        return np.concatenate(out)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for part in T.slices(batch.column("text")):
            buckets, bounds = features(part)
            for low, high in zip(bounds[:-1], bounds[1:]):
                i, c = np.unique(buckets[low:high], return_counts=True)
                ids.append(i.astype(np.int32).tobytes())
                counts.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
            names=["doc_id", "label", "ids", "counts"],
        )


def train(
    rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 4, rate: float = 40.0, seed: int = 7
) -> SubwordClassifier:
    """Fit vectors and softmax layer on (label, buckets, counts) by stochastic gradient descent."""
    good = sum(label for label, _, _ in rows)
    prior = (good + 1) / (len(rows) + 2)
    if not rows or good in (0, len(rows)):
        return SubwordClassifier(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(prior / (1 - prior))), prior)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, offset = random.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    # Both classes weigh the same in the loss, so scores are for equal shares of them.
    weight = {0: len(rows) / (2 * (len(rows) - good)), 1: len(rows) / (2 * good)}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in random.permutation(len(rows)):
            label, ids, counts = rows[k]
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = mean @ layer + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= min(weight[label], 8.0)
            back = layer @ p
            layer -= 0.05 * np.outer(mean, p)
            offset -= 0.05 * p
            vectors[ids] -= (step * 0.1) * share[:, None] * back
    slope = layer[:, 1] - layer[:, 0]
    return SubwordClassifier(vectors @ slope, float(offset[1] - offset[0]), prior)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> SubwordClassifier:
    """Train on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_texts(docs, labels, "quality", rows, ~held_out())
    found = sample.mapInArrow(_training_rows, "doc_id long, label int, ids binary, counts binary").toArrow()
    parsed = sorted(found.to_pylist(), key=lambda r: r["doc_id"])
    model = train([
        (int(r["label"] > 0), np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in parsed
    ])
    del found, parsed
    T.give_back()
    return model


def classify(docs: DataFrame, model: SubwordClassifier) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: SubwordClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
