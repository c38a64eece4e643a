"""Toxicity: cumulative-link ordinal regression on sparse text features.

Words (letters only, A to Z lower-cased) and their beginnings of four to eight bytes are
hashed into buckets, so that inflected words share features; a document's features are the
buckets it uses, each with weight log(1 + count). One weight vector serves all
thresholds: P(grade > k) is the logistic function of the weighted sum minus threshold k, and
thresholds are kept in order by learning the logarithms of their distances. The expected
severity is the sum of these probabilities.

Labels only say toxic or not, so grades above 0 are made from them first: buckets far more
usual in toxic rows than in others are markers, and a toxic row is graded 1, 2 or 3 by
thirds of the markers it uses. All of this is fitted in numpy on a bounded sample of
labelled rows; buckets that tell nothing there get no weight.

Defined results: a null or empty text has no features and gets the severity of a text
without any marker; repeated rows get equal results; without both kinds of labels nothing is
toxic; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import text as T
from riskloom.llm.training import SAMPLE_ROWS, held_out, labelled_texts

BUCKET_BITS = 18
GRADES = 3
BEGINNINGS = range(4, 9)
#: A document is called toxic from this probability of a grade above 0.
THRESHOLD = 0.35
#: Rows a bucket must occur in, and standard errors it must stand out by, to get a weight.
MIN_ROWS, MIN_ERRORS = 5, 4.0
_BREAK = np.ones(256, bool)
_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and word beginning of a slice."""
    low = T.LOWER[part.data]
    words = T.split_words(T.Slice(part.first, part.last, low, part.offsets), _BREAK)
    size = words.ends - words.starts
    starts, ends, owners = [words.starts], [words.ends], [words.owners]
    for n in BEGINNINGS:
        longer = size > n
        starts.append(words.starts[longer])
        ends.append(words.starts[longer] + n)
        owners.append(words.owners[longer])
    hashed = T.range_hashes(low, np.concatenate(starts), np.concatenate(ends))
    # A whole word and an equal beginning of a longer one are different features.
    whole = np.arange(len(hashed)) < len(words)
    bucket = (T.mix(hashed + whole.astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.concatenate(owners), bucket


def counted(owners: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order of text, and how often each occurs."""
    pair, count = np.unique(owners * (1 << BUCKET_BITS) + buckets, return_counts=True)
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1), count


@dataclass
class OrdinalModel:
    """Bucket weights, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, total: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold (n x grades)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - total[:, None], -40, 40)))

    def score(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text of a column."""
        out = [np.empty((0, len(self.thresholds)))]
        for part in T.slices(column):
            text, bucket = features(part)
            used = self.weights[bucket] != 0
            text, bucket, count = counted(text[used], bucket[used])
            value = self.weights[bucket] * np.log1p(count)
            out.append(self.above(np.bincount(text, value, minlength=len(part))))
        return np.concatenate(out)


def ordered(start: float, steps: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the distances."""
    return start + np.concatenate([[0.0], np.cumsum(np.exp(steps))])


def train(rows: list[tuple[bool, np.ndarray, np.ndarray]], steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> OrdinalModel:
    """Fit to rows of (toxic, buckets, counts) by gradient ascent on the likelihood of the grades."""
    weights = np.zeros(1 << BUCKET_BITS)
    toxic = np.array([r[0] for r in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return OrdinalModel(weights, np.arange(GRADES) + 20.0)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    bucket = np.concatenate([r[1] for r in rows])
    count = np.concatenate([r[2] for r in rows])

    # Buckets whose share of toxic rows stands out against all rows.
    n_in = np.bincount(bucket, minlength=len(weights))
    n_toxic = np.bincount(bucket[toxic[row]], minlength=len(weights))
    base = toxic.mean()
    errors = (n_toxic - n_in * base) / np.sqrt(np.maximum(n_in, 1) * base * (1 - base))
    telling = np.flatnonzero((n_in >= MIN_ROWS) & (np.abs(errors) >= MIN_ERRORS))
    if not len(telling):
        return OrdinalModel(weights, np.arange(GRADES) + 20.0)
    place = np.full(len(weights), -1)
    place[telling] = np.arange(len(telling))
    used = np.flatnonzero(place[bucket] >= 0)
    row, col, value = row[used], place[bucket[used]], np.log1p(count[used])

    # Grades of toxic rows: thirds by the markers they use.
    marker = errors[telling] > 0
    used = np.bincount(row, value * marker[col], minlength=len(rows))
    cuts = np.quantile(used[toxic], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, used, side="left"), 0)

    w, start, gaps = np.zeros(len(telling)), 1.0, np.zeros(GRADES - 1)
    moments = [np.zeros(len(telling) + GRADES) for _ in range(2)]
    for step in range(1, steps + 1):
        total = np.bincount(row, w[col] * value, minlength=len(rows))
        cuts = np.concatenate([[-np.inf], ordered(start, gaps), [np.inf]])
        # P(grade = g) = s(cut[g + 1] - total) - s(cut[g] - total)
        upper = 1 / (1 + np.exp(np.clip(total - cuts[grade + 1], -40, 40)))
        lower = 1 / (1 + np.exp(np.clip(total - cuts[grade], -40, 40)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope_w = np.bincount(col, (dl - du)[row] * value, minlength=len(telling)) / len(rows) - ridge * w
        by_cut = np.bincount(grade, du, minlength=GRADES + 1)[:GRADES] - np.bincount(grade, dl, minlength=GRADES + 1)[1:]
        by_cut /= len(rows)
        slope_gaps = np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]
        slope = np.concatenate([slope_w, [by_cut.sum()], slope_gaps])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = rate * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, start, gaps = w + move[: len(w)], start + move[len(w)], gaps + move[len(w) + 1 :]
    weights[telling] = w
    return OrdinalModel(weights, ordered(start, gaps))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch.column("text")):
            text, bucket = features(part)
            text, bucket, count = counted(text, bucket)
            cuts = np.searchsorted(text, np.arange(len(part) + 1)).tolist()
            buckets, counts = bucket.astype(np.int32), count.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(part.first, len(part)), batch.column("label").slice(part.first, len(part)),
                pa.array([buckets[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ], names=["doc_id", "label", "buckets", "counts"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Train on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_texts(docs, labels, "toxic", rows, ~held_out())
    found = sample.mapInArrow(_training_rows, "doc_id long, label int, buckets binary, counts binary").toArrow()
    parsed = sorted(found.to_pylist(), key=lambda r: r["doc_id"])
    return train([
        (r["label"] > 0, np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in parsed
    ])


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected severity (0 to 3), likeliest grade by thresholds, and whether the text is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(above.sum(1), pa.float64()),
                pa.array((above >= THRESHOLD).sum(1), pa.int32()), pa.array(above[:, 0] >= THRESHOLD),
            ], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
