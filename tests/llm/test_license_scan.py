"""License scan against a plain loop over rules, matches and pairs."""

import random
import re

import pytest

from riskloom.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base, places = set(), []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    joined = f" {' '.join(words)} " if words else " "
    found = []
    for _, own in L.rules():
        for label, rx, priority, weight in own:
            for m in re.finditer(rx, joined):
                first = joined[: m.start()].count(" ") - 1
                found.append((label, first, first + m[0].count(" ") + 1, priority, weight))
    kept = [d for d in found if not any(
        e[1] <= d[1] and d[2] <= e[2] and (e[3] > d[3] or e[3] == d[3] and e[2] - e[1] > d[2] - d[1]) for e in found)]
    score = max([0.0, 0.5 if places else 0.0, *(d[4] for d in kept)])
    labels = sorted(base | {d[0] for d in kept})
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score)


TEXTS = [
    None, "", " \n", "cc by", "CC-BY CC BY cc by cc by", "cc  by\nnc 4.0", "Released under the MIT License.", "GNU General Public License version 3",
    "licensed under the terms of the GNU General Public License v2 or later. All rights reserved", "Copyright (c) 2020 A B all rights reserved all rights reserved",
    "SPDX-License-Identifier: Apache-2.0", "É cc by", "permit license mit licence MIT", "apache license version 2.0 and apache license 1.1", "unlicense license",
    "in the public domain, public domain", "the the " * 3000 + "released under MIT " * 2000 + "cc by", "x" * 50_000, "dual licensed under the gpl license license mit",
    "Expat License", "licensed under GPLv2 or LGPLv3", "the FreeBSD license",
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)
    assert rows(L.op6_license_scan(spark, sf_dir)) == wanted


def test_odd_tables(spark):
    table = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "cc by"), (3, "cc by")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in table], "doc_id long, text string, n_words int, words string")
    scanned, detections = L.scan(docs)
    assert rows(L.summarise(scanned, L.unsuppressed(detections))) == sorted(((i, *plain(t)) for i, t in table), key=repr)
    scanned, detections = L.scan(docs.limit(0))
    assert rows(L.summarise(scanned, L.unsuppressed(detections))) == []


def test_rules_are_gated_by_what_they_need():
    all_rules = [(k, r) for k, own in L.rules() for r in own]
    assert len(all_rules) > 300
    for keyword, (label, rx, priority, weight) in all_rules:
        assert priority in L.PRIORITIES and 0 < weight <= 1
    names = {label: name for label, _, name in L.FAMILIES}
    assert len(names) > 30


@pytest.mark.parametrize("keyword,own", L.rules())
def test_matches_hold_keyword_and_trigger(keyword, own):
    samples = [f" {w} {' '.join(WORD.findall(t.lower()))} {w} " for t in filter(None, TEXTS[:-7]) for w in ("license", "under")]
    for label, rx, _, _ in own:
        for text in samples:
            if re.search(rx, text):
                assert any(t in text for t in L.TRIGGERS)


def written(tree, pick):
    """A text that a parsed rule matches; optional parts by ``pick``."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            out += "x" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "BRANCH":
            out += written(pick(arg[1]), pick)
        elif op == "SUBPATTERN":
            out += written(arg[3], pick)
        elif op == "MAX_REPEAT":
            low, high, part = arg
            out += "".join(written(part, pick) for _ in range(pick([low, min(high, low + 2)])))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


@pytest.mark.parametrize("keyword,own", L.rules())
def test_generated_matches_pass_both_gates(keyword, own):
    choose = random.Random(1).choice
    for label, rx, _, _ in own:
        tree = re._parser.parse(rx)
        for pick in [lambda options: options[0], lambda options: options[-1], *[choose] * 30]:
            text = f" {written(tree, pick)} "
            assert re.search(rx, text), (rx, text)
            assert f" {keyword} " in text and any(t in text for t in L.TRIGGERS), (rx, text)


def test_names_without_other_trigger_words(spark):
    names = ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution-NonCommercial 4.0", "creative commons attribution share alike", "CC0 1.0 Universal"]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    found = rows(L.summarise(*(lambda r, d: (r, L.unsuppressed(d)))(*L.scan(docs))))
    assert found == sorted(((i, *plain(t)) for i, t in enumerate(names)), key=repr)
    assert [r[6] for r in found] == ["cc-by", "cc-by-nc", "cc-by-sa", "cc0-1.0"]


def test_plan_is_native(spark, sf_dir):
    plan = L.op6_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
