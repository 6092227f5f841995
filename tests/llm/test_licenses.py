import random
import re
from re import _constants as c
from re import _parser

import pytest
from odd_tables import with_clashing_columns
from pyspark.sql import functions as F
from strandline.llm import licenses
from strandline.llm.license_rules import RULES, Rule, parse

SF = "/root/testdata/sf0.001"


def example(pattern, rng):
    """A text that the expression matches, chosen at random."""

    def of(tokens):
        out = []
        for op, arg in tokens:
            if op is c.LITERAL:
                out.append(chr(arg))
            elif op is c.SUBPATTERN:
                out.append(of(arg[3]))
            elif op is c.BRANCH:
                out.append(of(rng.choice(arg[1])))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += [of(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3)))]
            elif op is c.IN and arg[0][0] is c.NEGATE:
                out.append("x")
            elif op is c.IN:
                kind, value = rng.choice(arg)
                out.append(chr(value if kind is c.LITERAL else rng.randint(*value)))
            elif op is c.NOT_LITERAL:
                out.append("x")
            else:
                raise NotImplementedError(op)
        return "".join(out)

    return of(_parser.parse(pattern))


def brute(text, rules=RULES):
    """(n_words, places, detections) by whole-list comparison: every pair of detections, no automaton, no intervals."""
    text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    base = [(label, i) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    joined = "".join(f" {w} " for w in words)
    word_at = lambda x: joined[:x].count(" ") // 2
    spans = [(n, word_at(m.start()), word_at(m.end())) for n, r in enumerate(rules) for m in re.finditer(licenses.expression(r), joined)]
    kept = [s for s in spans if rules[s[0]].label and not any(o[0] < s[0] and o[1] <= s[1] and s[2] <= o[2] for o in spans)]
    return len(words), sorted(base, key=lambda b: (b[1], b[0])), sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def found(text, rules=RULES):
    import numpy as np

    n, rows = licenses._scan(np.frombuffer((text or "").encode(), dtype=np.uint8), licenses._scanner(tuple(rules)))
    return n, sorted([(r["label"], r["first_word"]) for r in rows if r["base"]], key=lambda b: (b[1], b[0])), [(r["rule"], r["first_word"], r["first_word"] + r["n_words"]) for r in rows if not r["base"]]


def test_there_are_hundreds_of_rules_and_each_is_reached():
    assert len(RULES) > 250
    assert len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    rng = random.Random(5)
    for n, r in enumerate(RULES):
        own = 0
        for _ in range(20):
            words = " ".join(example(r.pattern, rng).split())
            if not re.search(licenses.expression(r), "".join(f" {w} " for w in words.split())):
                continue  # the expression allows for spaces that words do not have
            assert licenses.doubled(r.keyword) in "".join(f" {w} " for w in words.split()), (r, words)
            _, _, rows = found(f"aa {words} zz")
            own += any(x == n for x, _, _ in rows)
        assert own or not r.label, r


def test_no_rule_is_hidden_by_a_wider_earlier_one():
    """The first rule that covers an example is the rule itself, for the plainest example of each."""
    rng = random.Random(1)
    for r in RULES:
        text = f"aa {' '.join(example(r.pattern, rng).split())} zz"
        assert found(text) == brute(text)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    pool = [example(r.pattern, rng) for r in rng.sample(RULES, 60)] + ["CC-BY", "cc by", "the", "a", "General Public License", "All rights reserved.", "é", "\n", "2.0", "version 3", "or later", "gnu"]
    text = " ".join(rng.choice(pool) for _ in range(400))
    assert found(text) == brute(text)
    few = rng.sample(RULES, 40)
    assert found(text, few) == brute(text, few)


def test_priority_and_containment():
    rules = parse("[0.0 decoys]\n | licence plate | licence plate\n[0.9 long]\nab | b c | b c\n[0.5 short]\nwide | a | a b c d\nin | b | b\nlicence | licence | licence")
    n, base, rows = found("a b c d x licence plate licence", rules)
    assert [(rules[i].label, lo, hi) for i, lo, hi in rows] == [("wide", 0, 4), ("ab", 1, 3), ("licence", 7, 8)]
    assert found("b c b c b", rules)[2] == [(1, 0, 2), (1, 2, 4), (3, 4, 5)]
    assert parse("") == [] and found("mit license", [])[2] == []
    held = licenses.Containment()
    for lo, hi in [(5, 9), (1, 3), (4, 12), (12, 13)]:
        assert not held.contains(lo, hi)
        held.add(lo, hi)
    assert held.starts == [1, 4, 12] and held.contains(6, 9) and not held.contains(2, 5)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0,license-statement"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0,license-statement"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl,gpl-2.0-or-later"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("My driver's license and the licence plate, a poetic license", ""),
        ("© Tous droits réservés. Alle Rechte vorbehalten.", "reserved"),
        ("permit smith licensee gplus mitlicense cc bypass", ""),
    ],
)
def test_known_notices(spark, text, labels):
    r = licenses.summaries(licenses.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert r.labels == labels and (r.score > 0) == bool(labels)


def test_odd_rows(spark, odd_docs, no_docs):
    long = "word, " * 300_000 + "MIT License " + "y" * 1_000_000 + " all rights reserved"
    docs = odd_docs.unionByName(spark.createDataFrame([(99, long, "en", "s", len(long))], odd_docs.schema))
    rows = licenses.summaries(licenses.detect(with_clashing_columns(docs))).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is None:
            assert r.n_words in (0, 3) and r.labels == ""
            continue
        n, base, kept = brute(texts[r.doc_id])
        at = [x for _, x in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in base}))
        assert r.labels == ",".join(sorted({x for x, _ in base} | {RULES[i].label for i, _, _ in kept}))
    assert next(r for r in rows if r.doc_id == 99).labels == "mit,reserved"
    assert licenses.summaries(licenses.detect(no_docs)).collect() == []


def test_more_rules_can_be_given(spark):
    docs = spark.createDataFrame([(1, "Sold under the Example Terms, version 7")], "doc_id long, text string")
    r = licenses.detect(docs, [*RULES, Rule("example-7", "example terms", "example terms version 7", 0.9)]).first()
    assert [(d.label, d.first_word, d.n_words) for d in r.detections] == [("example-7", 3, 4)]


def test_query_is_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in licenses.op13_license_rules(spark, SF).collect()}
    assert len(rows) == docs.count()
    lines = docs.where(F.col("text").rlike("(?i)licensed under|released under")).collect()
    assert lines and all(rows[r.doc_id].labels and rows[r.doc_id].score >= 0.8 for r in lines)
