"""Toxicity: gradient and order of thresholds, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa

from riskloom.llm import text as T, toxicity as X

ODD = [None, "", " ", "a", "idiot", "IDIOT idiot, idiot.", "ü é", "1 2 3", "x " * 30_000, "same same"]


def rows_of(random, n):
    """Synthetic rows: bucket 5 marks toxic rows, buckets 100 to 200 are noise."""
    out = []
    for _ in range(n):
        toxic = bool(random.random() < 0.3)
        noise = np.unique(random.integers(100, 200, 20))
        hits = int(random.integers(1, 9)) if toxic else 0
        buckets = np.concatenate([[5], noise]) if hits else noise
        counts = np.concatenate([[hits], np.ones(len(noise), int)]) if hits else np.ones(len(noise), int)
        out.append((toxic, buckets, counts))
    return out


def test_thresholds_are_ordered_and_severity_rises():
    model = X.train(rows_of(np.random.default_rng(0), 2000))
    assert (np.diff(model.thresholds) > 0).all()
    assert model.weights[5] > 0 and np.abs(model.weights[100:200]).max() < model.weights[5] / 5
    severity = model.above(model.weights[5] * np.log1p(np.arange(9))).sum(1)
    assert (np.diff(severity) > 0).all() and severity[0] < 0.3 and severity[8] > 1.5


def test_one_kind_of_label():
    rows = [(False, np.array([1]), np.array([1]))] * 20
    for given in ([], rows, [(True, *r[1:]) for r in rows]):
        assert X.train(given).above(np.zeros(1))[0, 0] < 0.01


def test_features_count_words():
    for part in T.slices(pa.array(ODD, pa.string())):
        text, bucket = X.features(part)
        assert np.bincount(text, minlength=10).tolist() == [0, 0, 0, 1, 2, 6, 2, 0, 30_000, 2]
        text, bucket, count = X.counted(text, bucket)
        # "idiot" and its beginning "idio"
        assert len(set(bucket[np.isin(text, [4, 5])])) == 2 and count[text == 5].tolist() == [3, 3]


def test_held_out(spark, sf_dir):
    found = X.op3_toxicity(spark, sf_dir)
    assert found.columns == ["doc_id", "severity", "grade", "toxic"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    rows = found.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert np.mean([r.toxic == bool(r.label) for r in rows]) >= 0.9
    assert all(0 <= r.severity <= X.GRADES and (r.grade > 0) == r.toxic for r in rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "a", "", 0), (4, "idiot", "", 1)], "doc_id long, text string, toxic string, grade int")
    labels = spark.createDataFrame([(i, 1, int(i in (4, 5))) for i in range(10)] + [(None, 1, 1), (3, 1, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for d, lab in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        assert X.grade(d, X.fit(d, lab)).count() == d.count()
