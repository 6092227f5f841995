import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import with_clashing_columns
from strandline.llm import collocations as co
from strandline.llm.collocations import collocations, frequent


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def brute_counts(rows):
    """{(lang, words): occurrences} and {lang: words} of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    return f, n


def brute(rows, least, top):
    f, n = brute_counts(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in {p[0] for p in cand}:
        own = []
        for (x, w), a in cand.items():
            if x != lang:
                continue
            longer = [b for (y, v), b in cand.items() if y == x and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, cut = min((2_000_000 * a // (f[x, w[:k]] + f[x, w[k:]]), k) for k in range(1, len(w)))
            own.append((-score, -a, " ".join(w).encode(), f[x, w[:cut]], f[x, w[cut:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "city", "hall", "a", "Été", "漢字", "x-y", "1", "''"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "! "]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 120)))) for _ in range(docs)]
    rows += [("en", "New York City Hall. " * 40), ("en", None), ("en", ""), (None, "...,,,"), ("de", "one"), ("", "a b " * 50)]
    return rows


def table(spark, rows):
    return with_clashing_columns(spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string"))


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 2000), (2, 8, 5), (3, 30, 10)])
def test_against_brute_force(spark, seed, least, top):
    rows = corpus(seed)
    found = collocations(frequent(table(spark, rows), least), top).collect()
    assert sorted(map(tuple, found)) == brute(rows, least, top)
    assert found


def test_slices_and_chunks_and_a_crowded_sketch_do_not_matter(spark, monkeypatch):
    rows = corpus(4)
    want = brute(rows, 5, 50)
    monkeypatch.setattr(co, "_SLICE_BYTES", 100)
    monkeypatch.setattr(co, "_CHUNK", 500)
    monkeypatch.setattr(co, "FEWEST_CELLS", 1024)  # of which each holds many phrases
    found = collocations(frequent(table(spark, rows), 5), 50).collect()
    assert sorted(map(tuple, found)) == want


def test_frequent_phrases_are_exact_and_none_is_lost(spark):
    rows = corpus(5, 200)
    f, n = brute_counts(rows)
    found = frequent(table(spark, rows), 6).collect()
    want = {(l, " ".join(w), len(w), a) for (l, w), a in f.items() if a >= 6} | {(l, None, 0, a) for l, a in n.items()}
    assert {tuple(r) for r in found if r.k or r.f} == {x for x in want if x[2] or x[3]}
    assert len(found) == len({(r.lang, r.phrase) for r in found})


def test_sketch_never_holds_less_and_filters(spark):
    rng = random.Random(6)
    text = " ".join([f"w{rng.randrange(200_000)}" for _ in range(60_000)] + ["hot phrase here"] * 50)
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    bitmaps = co.sketch(docs, 18, 30)
    (s, seeds, _), = co.slices(iter(docs.toArrow().to_batches()))
    kept = co.survivors(s, seeds, bitmaps)
    counts = brute_counts([("en", text)])[0]
    words = text.split()
    assert sum(map(len, kept)) < 0.01 * 4 * len(words)
    for k, where in enumerate(kept, 1):
        there = set(where.tolist())
        assert all(i in there for i in range(len(words) - k + 1) if counts["en", tuple(words[i : i + k])] >= 30)
    one = co.cells(np.arange(5, dtype=np.uint64) << np.uint64(32), 16)
    assert one[0].tolist() == [0] * 5 and one[1].tolist() == [0, 1, 2, 3, 4]


def test_counts_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, 2 * big + 1), ("en", None, 0, 4 * big), ("en", "a b c", 3, big * 8 // 10), ("en", "c", 1, 3 * big), ("en", "b c", 2, 2 * big - 1)]
    found = {r.phrase: r for r in collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).collect()}
    assert "a b" not in found  # 80 of 100 of its occurrences are in "a b c"
    assert found["b c"].score == 2_000_000 * (2 * big - 1) // (5 * big + 1)
    assert found["a b c"].score == 2_000_000 * (big * 8 // 10) // (4 * big)
    assert (found["a b c"].l, found["a b c"].r) == (big, 3 * big)


def test_equal_cuts_go_to_the_first(spark):
    rows = [("en", "a b c", 3, 10), ("en", "a", 1, 10), ("en", "b c", 2, 30), ("en", "a b", 2, 20), ("en", "c", 1, 20), ("en", "b", 1, 40), ("en", None, 0, 99)]
    r = next(r for r in collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).collect() if r.phrase == "a b c")
    assert (r.l, r.r, r.score, r.n) == (10, 30, 500_000, 99)


def test_odd_tables(spark, odd_docs, no_docs):
    found = collocations(frequent(with_clashing_columns(odd_docs), 2)).collect()
    assert sorted(map(tuple, found)) == brute([(r.lang, r.text) for r in odd_docs.collect()], 2, 2000)
    assert collocations(frequent(no_docs)).collect() == []
    assert collocations(frequent(odd_docs.limit(0))).collect() == []


def test_a_text_of_megabytes(spark):
    text = "alpha beta gamma. " * 100_000 + "z" * 1_000_000
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert [(r.phrase, r.a, r.n) for r in collocations(frequent(docs)).collect()] == [("alpha beta gamma", 100_000, 300_001)]


def test_joined_words():
    from strandline.llm.textvec import joined, text_buffer, word_codes, words_of

    data, off = text_buffer(pa.array(["aé  b", "", "c\td aé"]))
    w = words_of(data, off)
    assert joined(w, np.array([[0, 1], [2, 3], [4, 0]])).to_pylist() == ["aé b", "c d", "aé aé"]
    assert joined(w, np.zeros((0, 3), dtype=np.int64)).to_pylist() == []
    codes = word_codes(w)
    assert codes[0] == codes[4] and len(set(codes.tolist())) == 4
