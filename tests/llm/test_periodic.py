import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import sqlcompare
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import with_clashing_columns
from pyspark.sql import functions as F
from strandline.llm import periodic

SF = "/root/testdata/sf0.001"


def brute(s, least=periodic.LEAST, times=periodic.TIMES):
    """Runs (start, end, period) of a list by trying every period at every place."""
    out = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(((a, b - a, q) for a, b, q in brute(w)), key=lambda r: (r[0], r[2]))
    dropped = {i for a, n_, q in found for i in range(a + q, a + n_)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{a},{n_},{q}\n" for a, n_, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def of(s, least, times):
    return [(a - 1, b - 1, q) for a, b, q in periodic.runs(np.array([-1, *s, -2]), least, times).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.sampled_from([(1, 2), (2, 3), (4, 3), (6, 2), (24, 3)]), st.integers(1, 12), st.integers(0, 60))
def test_runs_of_any_sequence(s, limits, period, start):
    assert of(s, *limits) == brute(s, *limits)
    s = [s[start + (i - start) % period] if i >= start and start + period <= len(s) else x for i, x in enumerate(s)]
    assert of(s, *limits) == brute(s, *limits)


def test_factor_tables():
    rng = np.random.default_rng(3)
    s = np.concatenate([[100], rng.integers(0, 3, 300), [101]])
    f = periodic.Factors(s)
    sa = f.suffix_array()
    suffixes = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert sa.tolist() == suffixes
    i, j = rng.integers(0, 302, 500), rng.integers(0, 302, 500)
    i, j = i[i != j], j[i != j]
    length = lambda a, b: next(k for k in range(400) if k >= min(len(a), len(b)) or a[k] != b[k])
    assert f.forward(i, j).tolist() == [length(s[a:], s[b:]) for a, b in zip(i, j)]
    assert f.backward(i, j).tolist() == [length(s[: a + 1][::-1], s[: b + 1][::-1]) for a, b in zip(i, j)]
    lcp = np.concatenate([[0], f.forward(sa[:-1], sa[1:])])
    lpf, source = periodic.previous_factors(sa, lcp)
    for a in range(len(s)):
        best = max((length(s[a:], s[b:]) for b in range(a)), default=0)
        assert lpf[a] == best
        assert not best or (source[a] < a and length(s[a:], s[source[a] :]) == best)
    starts = periodic.blocks(lpf)
    assert starts[0] == 0 and all(b - a == max(1, lpf[a]) for a, b in zip(starts, starts[1:]))


def test_runs_inside_blocks_are_copied():
    """A run whose passage returns lies inside a block there: it is found by the copy from its bucket alone."""
    passage = [f"p{i}" for i in range(50)] + ["x", "y", "z"] * 12 + [f"q{i}" for i in range(50)]
    s = passage + ["between"] + passage + ["more"] + passage
    code = {w: i for i, w in enumerate(dict.fromkeys(s))}
    s = [code[w] for w in s]
    found = of(s, 24, 3)
    assert found == brute(s) == [(50, 86, 3), (187, 223, 3), (324, 360, 3)]
    f = periodic.Factors(np.array([-1, *s, -2]))
    sa = f.suffix_array()
    starts = periodic.blocks(periodic.previous_factors(sa, np.concatenate([[0], f.forward(sa[:-1], sa[1:])]))[0])
    assert len(periodic.border_runs(f, starts, 24, 3)) < 3


def test_a_small_part_of_borders_and_periods_at_a_time(monkeypatch):
    monkeypatch.setattr(periodic, "_PAIRS", 7)
    rng = random.Random(4)
    s = [rng.randrange(2) for _ in range(150)] + [1] * 40
    assert of(s, 4, 3) == brute(s, 4, 3)


@pytest.fixture
def periodic_docs(spark, odd_docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(100, 190):
        unit = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))] + unit * rng.randint(1, 12) + [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text), "en", "s", 0))
    line = "menu home about\n" * 40
    rows += [(300, line, "en", "s", 0), (301, line + "end", "en", "s", 0), (300, line, "en", "s", 0), (302, "a " * 23, "en", "s", 0), (303, "a " * 24, "en", "s", 0)]
    return odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))


@pytest.mark.parametrize("slice_bytes", [periodic._SLICE_BYTES, 1])
def test_against_brute_force(periodic_docs, monkeypatch, slice_bytes):
    monkeypatch.setattr(periodic, "_SLICE_BYTES", slice_bytes)
    docs = with_clashing_columns(periodic_docs)
    rows = periodic.summaries(periodic.find_runs(periodic.with_periods(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))).collect()
    want = [brute_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert sum(r.n_runs > 0 for r in rows) > 40


def test_operator_gives_runs_and_texts(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b " * 12 + "c"), (2, None)], "doc_id long, text string")
    rows = periodic.find_runs(docs).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(25, [(0, 24, 2)], "a b c"), (0, [], "")]
    assert periodic.summaries(periodic.find_runs(no_docs)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(1)
    w = [f"{rng.randrange(5000)}" for _ in range(150_000)]
    w[70_000:70_000] = [f"x{i}" for i in range(40_000)] * 3
    text = " ".join(w)
    assert len(text) > 1_000_000
    r = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(70_000, 120_000, 40_000)]
    assert r.collapsed == " ".join(w[:110_000] + w[190_000:])


def test_sql_on_periodic_texts(spark, periodic_docs, tmp_path):
    """The query's SQL on texts that repeat themselves more than those of the tables do."""
    docs = periodic_docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for t in sqlcompare.TABLES:
        (docs if t == "documents" else spark.range(1)).toPandas().to_parquet(tmp_path / f"{t}.parquet")
    sqlcompare.check(spark, periodic.op12_periodic_runs, periodic.OP12_SQL, str(tmp_path))
