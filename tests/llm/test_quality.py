"""Quality classifier and quality rules: brute force on a fixture, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import quality_classifier as QC, quality_rules as QR, text as T

ODD = [
    None, "", " ", "\n\n", "one", "a b", "a a a a", "x y z x y z", "l1\nl1\n\nl1\n l1", "é ü\tñ\x0bß\x0c#*$",
    "Der # $ | <b> &amp; %", "w " * 30_000, "tail", "é" * 5000, "a\r\na\r\nb", "q\n" * 60,
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places, covered = {}, set()
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_counts_equal_brute_force(monkeypatch):
    random = np.random.default_rng(3)
    texts = ODD + [" ".join(random.choice(["a", "b", "ü", "c\n", "\n", "d|"], 80)) for _ in range(200)]
    for size in (1 << 21, 50):
        monkeypatch.setattr(T, "SLICE_BYTES", size)
        counts, failed, _, kept = QR.judge(pa.array(texts, pa.string()), None)
        wanted = np.array([plain_counts(t) for t in texts])
        assert (counts == wanted).all(), [(t[:30] if t else t, c, w) for t, c, w in zip(texts, counts, wanted) if (c != w).any()]
        assert (failed == [w[0] < 50 or 100 * w[4] > 50 * w[0] for w in wanted]).all()


def test_trees_are_monotonic_and_learn():
    random = np.random.default_rng(1)
    x = random.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    y[random.random(3000) < 0.05] = 0
    model = QR.train(x, y, [-1, 1, 0])
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.93
    grid = np.repeat(random.random((300, 1, 3)), 50, 1)
    grid[:, :, 0] = np.linspace(0, 1, 50)
    assert (np.diff(model.score(grid.reshape(-1, 3)).reshape(300, 50), axis=1) <= 1e-12).all()
    assert QR.train(x, np.ones(3000), [0, 0, 0]) is None


def test_rules_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = QR.measure(docs, QR.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0 and not base_failed")
    rows = found.select("quality", "kept").collect()
    assert np.mean([bool(r.quality) == r.kept for r in rows]) >= 0.9
    assert np.mean([r.kept for r in rows if r.quality]) >= 0.95


def test_classifier_held_out(spark, sf_dir):
    rows = QC.op8_quality_classifier(spark, sf_dir)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = rows.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.quality == r.predicted for r in rows if r.held_out]) >= 0.9


def test_features_by_slice_do_not_depend_on_neighbours(monkeypatch):
    alone = [QC.features(next(T.slices(pa.array([t], pa.string()))))[0] for t in ODD]
    part = next(T.slices(pa.array(ODD, pa.string())))
    together, bounds = QC.features(part)
    for k, want in enumerate(alone):
        assert sorted(together[bounds[k] : bounds[k + 1]]) == sorted(want)


@pytest.mark.parametrize("module", [QC, QR])
def test_odd_tables(spark, module):
    schema = "doc_id long, text string, score double, kept string, label string"
    docs = spark.createDataFrame([(i, t, 0.5, "x", "y") for i, t in enumerate(ODD)] + [(None, "a b", None, None, None), (1, "", 0.1, "", "")], schema)
    labels = spark.createDataFrame([(4, 1, 0), (7, None, 0), (None, 1, 1), (11, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    apply = module.classify if module is QC else module.measure
    for d, lab in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        model = module.fit(d, lab)
        assert apply(d, model).count() == d.count()
        kept = module.keep_good(d, model)
        assert kept.columns == d.columns and kept.count() <= d.count()
