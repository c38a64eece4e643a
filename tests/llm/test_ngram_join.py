"""N-gram Jaccard join against brute force, and its parts."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ngram_join as J, text as T
from riskloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    """[(doc_id, text)] -> sorted (doc_id, n, component)"""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    pairs = {p for v in where.values() for p in combinations(v, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min([x for x in (least.get(root(k)), i) if x is not None], default=None)
    return sorted(((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def near_copies(seed, n, vocabulary, sizes):
    random = np.random.default_rng(seed)
    texts = []
    while len(texts) < n:
        words = random.integers(0, vocabulary, random.choice(sizes)).tolist()
        for _ in range(random.integers(1, 9)):
            copy = list(words)
            for _ in range(random.integers(0, 1 + len(words) // 20)):
                at = random.integers(0, len(copy) + 1)
                copy[at : at + random.integers(0, 2)] = [int(random.integers(0, vocabulary))] * random.integers(0, 2)
            texts.append(" ".join(f"W{w}" for w in copy))
    return [(int(i), t) for i, t in zip(random.permutation(len(texts)), texts)]


def test_full_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sorted((tuple(r) for r in J.op2_ngram_join(spark, sf_dir).collect()), key=repr)
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block,blocks", [(1024, 32), (3, 32), (3, 1)])
def test_near_copies_of_all_sizes(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCKS", blocks)
    rows = near_copies(5, 400, 3000, [3, 5, 8, 9, 12, 20, 40, 80, 150])
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + k, f"{passage} {' '.join(f'u{k}x{j}' for j in range(k % 12))}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in J.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert found == brute(rows)


def test_short_texts_and_one_word_more(spark):
    rows = []
    for n in range(6, 16):
        words = [f"n{n}w{k}" for k in range(n)]
        rows += [" ".join(words), " ".join([*words, "behind"])]
        words = [f"m{n}w{k}" for k in range(n)]
        rows += [" ".join(words), " ".join(["before", *words]), " ".join(["in", *words, "between"])]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in J.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert found == brute(rows)
    nine = [i for i, t in rows if t.startswith("n9w0")]
    assert {c for i, _, c in found if i in nine} == {min(nine)}


ODD = [None, "", " \n", "a", "A", "a b c", "a  B c", "a b c d", "é É", "a\xa0b", "w " * 20_000, "w " * 20_001, "x y z w v u t s r q p o n m l k"]


def test_odd_tables(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a b c"), (None, "q r s t"), (None, ""), (7, "other words than before here")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, sid int, component_id string")
    found = sorted((tuple(r) for r in J.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert found == brute(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain_set(t)].append((i, t))
    assert kept.count() == len(groups) - 1 + len(groups[frozenset()])
    assert J.near_duplicates(docs.limit(0)).count() == 0 and J.keep_one(docs.limit(0)).count() == 0


def test_pigeonhole_keeps_every_link():
    random = np.random.default_rng(8)
    classes = J.size_classes(400)
    for _ in range(3000):
        n = int(random.integers(7, 300))
        one = np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64))
        drop, add = random.integers(0, 1 + n // 7), random.integers(0, 1 + n // 7)
        two = np.unique(np.concatenate([random.permutation(one)[drop:], random.integers(0, 1 << 63, add, dtype=np.uint64)]))
        if J.linked(one, two):
            assert set(J.signatures(one, classes)[0]) & set(J.signatures(two, classes)[0])


def test_tree_loses_no_pair():
    random = np.random.default_rng(4)
    base = [np.unique(random.integers(0, 1 << 63, int(random.integers(5, 90)), dtype=np.uint64)) for _ in range(12)]
    sets = []
    for s in base:
        for _ in range(9):
            sets.append(np.unique(np.concatenate([random.permutation(s)[: len(s) - random.integers(0, 4)], random.integers(0, 1 << 63, random.integers(0, 4), dtype=np.uint64)])))
    found = {tuple(sorted(p)) for p in J.SignatureTree(sets).candidates()}
    wanted = {(a, b) for a, b in combinations(range(len(sets)), 2) if J.linked(sets[a], sets[b])}
    assert wanted <= found and len(found) < len(sets) * (len(sets) - 1) / 4
    assert J.tree_links(sets, ["same"] * len(sets), list(range(len(sets)))) == []
    assert J.tree_links(sets, list(range(len(sets))), ["one side"] * len(sets)) == []


def test_shingles_do_not_depend_on_slices(monkeypatch):
    texts = ODD + ["a b c d e a b c d"]
    monkeypatch.setattr(T, "SLICE_BYTES", 10)
    for part in T.slices(pa.array(texts, pa.string())):
        runs, bounds = J.shingle_sets(part)
        assert np.diff(bounds).tolist() == [len(plain_set(t)) for t in texts[part.first : part.last]]


def test_components(spark):
    random = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (260, 2))] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[x] == root(x) for a, b in edges if a != b for x in (a, b))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
