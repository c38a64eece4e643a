"""Packing: every id in exactly one piece, sequences without gaps, little padding, exact checksums."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskloom.llm import packing as K, text as T


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path(K.VOCABULARY_FILE))


def check(rows, texts, tokenizer, length=2048):
    """``texts``: a list of (doc_id, text). Returns the share of padding."""
    wanted = defaultdict(list)
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        wanted[i].append(ids)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(wanted)
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, wanted[i]))
        if len(wanted[i]) == 1:
            (ids,), at = wanted[i], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(1, len(by_sequence) * length)


def test_full_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = K.op5_packing(spark, sf_dir).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer) < 0.005


ODD = [None, "", " ", "a", "x " * 5000, "<|endoftext|> <|startoftext|>", "a<|endoftext|>b<|EndOfText|>", "<|endoftext|><|endoftext|>", "x<|startoftext|>\u0301é",
       "<|end", "oftext|>", "<|endoftext|> [UNK] <unk>", "<|endoftext", "don't, -'s 'LL a'b.c", "Ünï̇ K̸ ≮ İ", "a\x0bb\x0cc\x85d\xa0e", "１２ ½"]


@pytest.mark.parametrize("n", [0, 1, len(ODD)])
def test_odd_tables(spark, tokenizer, n):
    texts = list(enumerate(ODD))[:n]
    if n > 1:
        texts += [(None, "b c"), (None, "b"), (3, "a"), (3, "a"), (4, "x " * 5000)] + [(100 + k, "same words here") for k in range(700)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in texts], "doc_id long, text string, sequence_id string, length int")
    assert check(K.pack(docs).collect(), texts, tokenizer) < 0.03  # a handful of sequences


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abIKs'., \n\t\x0b\x85-<>1é̸̇́"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_units_equal_the_tokenizer(tokenizer, texts):
    own = TOKENS.setdefault("own", None) or TOKENS.update(own=K.WordTokens(open(P.path(K.VOCABULARY_FILE), encoding="utf-8").read())) or TOKENS["own"]
    for part in T.slices(pa.array(texts, pa.string())):
        ids, bounds = own.encode(part)
        for k, t in enumerate(texts[part.first : part.last]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "B", " ", "endoftext", "\u0301", "é", "'s", "<|EndOfText|>"]), max_size=12), max_size=4))
def test_added_tokens_equal_the_tokenizer(tokenizer, texts):
    test_units_equal_the_tokenizer.hypothesis.inner_test(tokenizer, ["".join(t) for t in texts])


TOKENS: dict = {}


def test_knapsack_equals_brute_force():
    random = np.random.default_rng(0)
    for _ in range(30):
        sizes = np.unique(random.integers(1, 9, 4))
        values = random.random(len(sizes))
        best = [0.0]
        for room in range(1, 21):
            best.append(max([best[-1]] + [best[room - s] + v for s, v in zip(sizes, values) if s <= room]))
        worth, pattern = K.best_pattern(values, sizes, 20)
        assert abs(worth - best[20]) < 1e-9 and abs(pattern @ values - worth) < 1e-9 and pattern @ sizes <= 20


def test_linear_program_reaches_the_bound():
    random = np.random.default_rng(2)
    sizes = np.arange(1, 129)
    demand = random.integers(0, 500, 128) // sizes + 1.0  # many small ones, so the volume can be reached
    patterns, used = K.solve_patterns(sizes, demand, 128)
    assert np.allclose(used @ patterns, demand) and (patterns @ sizes <= 128).all()
    assert used.sum() <= demand @ sizes / 128 * 1.002


def test_plan_deals_each_rank_once():
    histogram = {3: 70, 5: 1, 9: 300, 16: 12, 12: 33}
    plan = K.make_plan(histogram, 16)
    load = defaultdict(int)
    for b, n in histogram.items():
        for s in plan.sequence(b, np.arange(n)):
            load[s] += b if s >= 0 else 0
    assert all(v <= 16 for s, v in load.items() if s >= 0) and set(range(plan.sequences)) <= set(load)


def test_cut_points():
    assert K.cut_points(0, 8).tolist() == [] and K.cut_points(8, 8).tolist() == [0]
    assert K.cut_points(21, 8).tolist() == [0, 8, 16, 20]
