"""Byte-level BPE: equal to the tiktoken library and an exact round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from riskloom.llm import byte_bpe as B, text as T

SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0     　"
TEXTS = [
    None, "", " ", "  a", "don't  we'll\n\n x", "a\xa0\n b", "a　\t b\xa0", "x\x1c y \x85 z", "<|endoftext|> a", "퟿\U0001f600 é  ",
    "a" * 20_000, " ".join(["word"] * 5000), "日本語 テキスト", "́ é x", "1234567 12 ½", "\x00\x7f \x01 b", "<unk> x",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(B.RANK_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return B.ByteBpe(B.serialise(B.read_ranks(P.path(B.RANK_FILE))), P.PATTERN)


def encoded(coder, texts):
    out = []
    for part in T.slices(pa.array(texts, pa.string())):
        ids, bounds = coder.encode(part)
        data, ends = coder.decode(ids, bounds)
        for k in range(len(part)):
            assert data[ends[k] : ends[k + 1]].tobytes() == (texts[part.first + k] or "").encode()
            out.append(ids[bounds[k] : bounds[k + 1]].tolist())
    return out


def test_equals_library(coder, reference, monkeypatch):
    for size in (1 << 21, 40):
        monkeypatch.setattr(T, "SLICE_BYTES", size)
        for text, ids in zip(TEXTS, encoded(coder, TEXTS)):
            assert ids == reference.encode_ordinary(text or ""), text


def test_every_vocabulary_entry(coder, reference):
    words = [w.decode() for w in B.read_ranks(P.path(B.RANK_FILE)) if w.decode("utf-8", "ignore").encode() == w]
    assert encoded(coder, words) == [reference.encode_ordinary(w) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(SPACES + "ab'sé1!ł"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text(coder, reference, texts):
    assert encoded(coder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_rows(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (1, "", "y")], "doc_id long, text string, n_tokens string")
    rows = B.round_trip(docs, with_ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.n_tokens == len(reference.encode_ordinary("a b"))
            continue
        text = TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids == ids and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.round_trip(docs.limit(0)).count() == 0
