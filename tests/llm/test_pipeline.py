"""The pipeline: each stage against a plain version on its own input, and the whole run."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from riskloom.llm import packing, quality_classifier as QC, quality_rules as QR
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check as check_pieces
from tests.llm.test_pii import plain as plain_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    folder, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_columns(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert len(C.STAGES) == 5 and all(after.columns == columns for _, after in stages[:-1])


def test_filters_follow_their_operators(stages, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before, after = stages[0]
    rows, model = before.select("doc_id", "text").collect(), QC.fit(before, labels)
    kept = model.score(pa.array([r.text for r in rows], pa.string())) >= QC.THRESHOLD
    assert set(texts(after)) == {r.doc_id for r, k in zip(rows, kept) if k}
    before, after = stages[1]
    rows, model = before.select("doc_id", "text").collect(), QR.fit(before, labels)
    kept = QR.judge(pa.array([r.text for r in rows], pa.string()), model)[3]
    assert set(texts(after)) == {r.doc_id for r, k in zip(rows, kept) if k}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    long = {i for i, t in texts(stages[1][0]).items() if i in good and len(t.split()) >= 60}
    assert np.mean([i in texts(after) for i in long]) > 0.97


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    rows = brute(list(texts(before).items()))
    assert set(texts(after)) == {i for i, _, component in rows if i == component}


def test_no_base_span_is_left(stages):
    before, after = map(texts, stages[3])
    assert set(before) == set(after)
    for i, text in before.items():
        assert not plain_spans(after[i])
        if not any(c.isdigit() or c == "@" for c in text):
            assert after[i] == text
    assert all(r.n_chars == len(r.text) for r in stages[3][1].collect() if r.text is not None and before[r.doc_id] != r.text)


def test_pieces_hold_every_token(stages):
    tokenizer = Tokenizer.from_file(P.path(packing.VOCABULARY_FILE))
    before, after = stages[4]
    assert check_pieces(after.collect(), list(texts(before).items()), tokenizer) < 0.01


def test_run(spark):
    """On the smallest tables, with every query registered."""
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
