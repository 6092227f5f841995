import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from odd_tables import with_clashing_columns
from strandline.llm import suffix


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (20, 40, 60, 200)]
    texts = [prose(r.randrange(80)) + (r.choice(shared) if r.random() < 0.6 else "") + prose(r.randrange(80)) for _ in range(60)]
    texts += texts[:4] + [t[3:] for t in texts[:4]] + [texts[0] + texts[1]]
    texts += ["q" * 700, "q" * 450, "x" * 200, "x" * 201, "z" * 199, "ab" * 200, "abc" * 150 + prose(9), prose(5) + "abc" * 150, "", None, " ", "y" * 199 + "1", "y" * 199 + "2"]
    period = prose(12)[:60]
    return texts + [period * 5, prose(50) + period * 6]


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix, "HOT", 1)
    texts = corpus(1 + hot)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(with_clashing_columns(df), block_bytes=9000).collect()}
    want = dict(enumerate(brute(texts)))
    assert {i: (found[i], texts[i]) for i in want if found[i] != want[i]} == {}


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in suffix.remove_repeats(odd_docs).collect())
    assert found == sorted((r.doc_id is None, r.doc_id or 0, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    assert suffix.remove_repeats(no_docs).count() == 0
    assert suffix.cut_repeats(no_docs).count() == 0


def test_cut_keeps_columns(spark):
    r = random.Random(2)
    passage = "é" * 3 + "".join(r.choice("abcdef ") for _ in range(400))
    rows = [(1, "start " + passage, "en", "s", 5), (2, passage + " end", "en", "s", 5), (3, None, None, None, None)]
    df = with_clashing_columns(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "start ", 2: " end", 3: ""}


def test_map_and_array_columns(spark):
    passage = "".join(random.Random(4).choices("abcdef ", k=400))
    df = spark.sql("select 1 as doc_id, map('a', 1, 'b', 2) as m, array(map(1, 'x')) as n, cast('00' as binary) as z").crossJoin(spark.createDataFrame([(passage + " one",), (passage + " two",), (passage + " two",), (None,)], "text string"))
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["", "", "", "one"]
    assert {str(r.m) for r in out.collect()} == {str(df.first().m)}


def test_a_passage_that_many_share_is_indexed_once(spark, monkeypatch):
    """Of a hot anchor's parts equal ones are counted, and one of each goes on to an index."""
    monkeypatch.setattr(suffix, "HOT", 5)
    r, seen = random.Random(6), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    match = suffix._match

    def counted(length, batch_bytes):
        run = match(length, batch_bytes)

        def rows(batches):
            for b in batches:
                open(f"{where}/{random.getrandbits(64)}", "w").write(str(b.num_rows))
                yield from run([b])

        return rows

    import tempfile

    where = tempfile.mkdtemp()
    monkeypatch.setattr(suffix, "_match", counted)
    found = {x.doc_id: tuple(x)[1:] for x in suffix.remove_repeats(df).collect()}
    assert found == dict(enumerate(brute(texts)))
    import pathlib

    assert 0 < sum(int(x.read_text()) for x in pathlib.Path(where).iterdir()) < 20 * 60


def test_family_finds_matches_across_batches():
    r = np.random.default_rng(3)
    for length in (16, 24, 40):
        family, seen = suffix.SuffixFamily(length), []
        for _ in range(9):
            n = int(r.integers(1, 40))
            text = r.integers(0, 2, length + n + 20).astype(np.uint8)
            if seen and r.random() < 0.7:
                text[: length + 3] = seen[int(r.integers(len(seen)))][: length + 3]
            position = np.sort(r.choice(len(text) - length + 1, n, replace=False))
            family.add(text, position)
            seen.append(text)
            windows = getattr(family, "_all", [])
            family._all = windows + [bytes(text[p : p + length]) for p in position]
            count = Counter(family._all)
            assert family.hit.tolist() == [count[w] > 1 for w in family._all]
            sizes = [len(x.order) for x in family.levels]
            assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
            for level in family.levels:
                own = [bytes(level.text[p : p + length]) for p in level.order]
                assert own == sorted(own)
