"""Blocks of alignments against one table for each pair, letter by letter."""

import random

import pyarrow as pa
import pytest
from strandline.operators import align
from strandline.params import SketchParams


def complement(s):
    return s.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]


def model(q, s, match=2, mismatch=-1, gap=-1):
    n, m = len(q), len(s)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    pair = lambda i, j: match if q[i - 1] == s[j - 1] else mismatch
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = max(d[i - 1][j - 1] + pair(i, j), d[i - 1][j] + gap, d[i][j - 1] + gap)
    side = [row[m] for row in d]
    i, j = (n, d[n].index(max(d[n]))) if max(d[n]) >= max(side) else (side.index(max(side)), m)
    score, top, bottom = d[i][j], q[i:] + "_" * (m - j), "_" * (n - i) + s[j:]
    while i and j:
        if d[i][j] == d[i - 1][j - 1] + pair(i, j):
            i, j, top, bottom = i - 1, j - 1, q[i - 1] + top, s[j - 1] + bottom
        elif d[i][j] == d[i - 1][j] + gap:
            i, top, bottom = i - 1, q[i - 1] + top, "_" + bottom
        else:
            j, top, bottom = j - 1, "_" + top, s[j - 1] + bottom
    return score, "_" * j + q[:i] + top, s[:j] + "_" * i + bottom


def model_both(q, s, *scheme):
    plain, other = model(q, s, *scheme), model(complement(q), s, *scheme)
    return plain if plain[0] > other[0] else other


def some_pairs(r, n):
    out = [("", ""), ("", "ACG"), ("AC", ""), ("A", "A"), ("A" * 50, "A" * 20)]
    for _ in range(n):
        s = "".join(r.choice("ACGTNaé\U0001f600" if r.random() < 0.1 else "ACGT") for _ in range(r.randrange(80)))
        q = "".join(r.choice("ACGT") for _ in range(r.randrange(50))) if r.random() < 0.4 else s[3:60].replace("A", "", 1)
        q = complement(q) if r.random() < 0.3 else q
        out.append(("".join(r.choice("ACGT") for _ in range(r.randrange(20))) + s + "ACC" if r.random() < 0.1 else q, s))
    return out


@pytest.mark.parametrize("scheme", [(2, -1, -1), (1, -2, -3), (3, -1, 0)])
@pytest.mark.parametrize("cells", [align.BLOCK_CELLS, 4000])
def test_blocks_of_pairs(monkeypatch, scheme, cells):
    monkeypatch.setattr(align, "BLOCK_CELLS", cells)
    pairs = some_pairs(random.Random(4), 120)
    q, s = (pa.array(x) for x in zip(*pairs))
    rows = lambda b: list(zip(*(c.to_pylist() for c in b.columns)))
    assert rows(align.align_pairs(q, s, *scheme)) == [model(*p, *scheme) for p in pairs]
    assert rows(align.align_pairs(q, s, *scheme, strands=True)) == [model_both(*p, *scheme) for p in pairs]


def test_nulls_and_nothing():
    found = align.align_pairs(pa.array([None, "AC"]), pa.array(["AC", None])).to_pylist()
    assert [tuple(x.values()) for x in found] == [(0, "__", "AC"), (0, "AC", "__")]
    assert align.align_pairs(pa.array([], pa.string()), pa.array([], pa.string())).num_rows == 0


def test_one_long_pair():
    """More rows than are kept, so that the way back fills several stretches anew."""
    r = random.Random(6)
    s = "".join(r.choice("ACGT") for _ in range(900))
    q = s[100:300] + s[310:700].replace("ACG", "AG") + "TTT" + s[700:850]
    assert tuple(align.align_pairs(pa.array([q]), pa.array([s])).to_pylist()[0].values()) == model(q, s)


@pytest.mark.parametrize("broadcast", [True, False])
def test_slices_over_pieces(spark, monkeypatch, broadcast):
    monkeypatch.setattr(align, "PIECE", 40)
    if not broadcast:
        monkeypatch.setattr(align, "bounded_broadcast", lambda df, row_bytes: df)
    r, p = random.Random(7), SketchParams(4, 4, 30, 10)
    dna = {t: "".join(r.choice("ACGT") for _ in range(n)) for t, n in enumerate([400, 40, 41, 7, 0])}
    targets = spark.createDataFrame([*dna.items(), (9, None)], "tgt long, dna string")
    rows = [(q, t, b, b + r.randrange(8)) for q, (t, b) in enumerate((t, b) for t in [*dna, 8, 9] for b in range(0, max(1, len(dna.get(t, "")) // 10), 3))]
    cand = spark.createDataFrame([*rows, *[(x[0] + 1000, *x[1:]) for x in rows[:5]]], "query_id long, tgt long, beg int, end int")
    found = align.slices(cand, targets, p).collect()
    assert len(found) == len(rows) + 5
    for x in found:
        assert (x.part or "") == dna.get(x.tgt, "")[x.beg * 10 : x.end * 10 + 30]
    reads = spark.createDataFrame([(q, "".join(r.choice("ACGT") for _ in range(25))) for q in range(len(rows))], "query_id long, seq1 string")
    texts = dict(map(tuple, reads.collect()))
    got = {x.query_id: tuple(x)[2:] for x in align.align_candidates(cand, reads, targets, p).collect()}
    parts = {x.query_id: x.part for x in found if x.query_id < 1000}
    assert got == {q: model_both(texts[q], s) for q, s in parts.items() if s is not None}
