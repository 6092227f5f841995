"""Wide k-mers, other hashes and other sketchers, against plain models."""

import random
from dataclasses import replace

import numpy as np
import pytest
from strandline.functions import features
from strandline.operators import sketching
from strandline.operators.layers import LayeredIndex
from strandline.params import SketchParams
from strandline.plans import modes

ALL_ONES = 2**64 - 1


def model_finaliser(x, rounds, last):
    for shift, factor in rounds:
        x = (x ^ x >> shift) * factor & ALL_ONES
    return x ^ x >> last


def model_mix32(x):
    for _ in range(2):
        x = (x >> 16 ^ x) * 0x45D9F3B & 0xFFFFFFFF
    return x >> 16 ^ x


HASHES = {"mix32": model_mix32, "murmur64": lambda x: model_finaliser(x, [(33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)], 33), "splitmix64": lambda x: model_finaliser(x, [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)], 31)}


def canonical_code(kmer):
    other = kmer.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return int(min(kmer, other).translate(str.maketrans("ACGT", "0123")), 4)


def closed(kmer):
    s = max(1, len(kmer) // 2)
    h = [model_mix32(canonical_code(kmer[i : i + s])) for i in range(len(kmer) - s + 1)]
    return min(h) in (h[0], h[-1])


def model_sketch(window, p):
    kmers = [window[i : i + p.k].upper() for i in range(len(window) - p.k + 1)]
    kmers = [x for x in kmers if set(x) <= set("ACGT") and (p.sketcher == "minhash" or closed(x))]
    bits = 32 if p.hasher == "mix32" else 64
    found = sorted({HASHES[p.hasher](canonical_code(x)) for x in kmers} - {2**bits - 1})[: p.size]
    return [x - 2**64 if x >= 2**63 else x for x in found]


def model_windows(seq, p):
    if len(seq) <= p.window:
        return [seq]
    starts = [i for i in range(0, len(seq), p.stride) if i + p.window <= len(seq)]
    rest = starts[-1] + p.stride
    return [seq[i : i + p.window] for i in starts] + ([seq[rest:]] if rest < len(seq) else [])


POLICIES = [SketchParams(17), SketchParams(21), SketchParams(32, 4, 60), SketchParams(12, hasher="splitmix64"), SketchParams(16, sketcher="syncmer"), SketchParams(25, 8, 90, sketcher="syncmer"), SketchParams(1, sketcher="syncmer")]


@pytest.mark.parametrize("p", POLICIES)
def test_policies_of_both_engines(spark, p):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("ACGTACGTACGTACGTNacgt") if i % 2 else r.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 1, p.k - 1, p.k, 31, 32, 33, 128, 129, 400, 700])]
    rows += [(90, "T" * 100), (91, "A" * 40 + "N" * 40 + "C" * 40), (92, None)]
    df = spark.createDataFrame(rows, "tgt long, dna string")
    want = sorted((i, w, f) for i, s in rows if s for w, x in enumerate(model_windows(s, p)) for f in model_sketch(x, p))
    for engine in ("sql", "arrow"):
        assert sorted(map(tuple, sketching.sketch_features(df, "tgt", "dna", p, engine).collect())) == want


def test_strands_have_the_same_features(spark):
    r = random.Random(3)
    s = "".join(r.choice("ACGT") for _ in range(100))
    df = spark.createDataFrame([(0, s), (1, s.translate(str.maketrans("ACGT", "TGCA"))[::-1])], "tgt long, dna string")
    for p in POLICIES:
        found = sketching.sketch_features(df, "tgt", "dna", replace(p, window=128, stride=128)).collect()
        of = lambda t: {x.feature for x in found if x.tgt == t}
        assert of(0) == of(1) and of(0)


def test_names_and_widths():
    assert SketchParams(16).hasher == "mix32" and SketchParams(17).hasher == "murmur64" and SketchParams(40).k == 32
    for p in (SketchParams(sketcher="none"), SketchParams(hasher="none"), SketchParams(17, hasher="mix32")):
        with pytest.raises(ValueError):
            features.policy(p)


def test_own_policy(spark, monkeypatch):
    """A selection that is added by name is used by both engines: k-mers without the first base and its complement."""
    from pyspark.sql import functions as F

    def no_a(base, k):
        return np.lib.stride_tricks.sliding_window_view((base == 0) | (base == 3), k).sum(axis=1) == 0

    monkeypatch.setitem(features.SELECTIONS, "no-a", features.Selection(lambda x, k: F.length(F.translate(x, "AT", "")) == k, no_a))
    p = SketchParams(4, sketcher="no-a")
    df = spark.createDataFrame([(0, "CCCCGACGGGCTTCGCGC")], "tgt long, dna string")
    both = [sorted(map(tuple, sketching.sketch_features(df, "tgt", "dna", p, e).collect())) for e in ("sql", "arrow")]
    assert both[0] == both[1] and len(both[0]) == len({canonical_code(x) for x in ("CCCC", "CCCG", "CGGG", "GGGC", "CGCG", "GCGC")}) == 5


def test_databases_of_two_policies(spark, tmp_path):
    """Both are built, stored, loaded and asked in one session; reads of another policy are refused, and so is a database whose
    sketcher is not known."""
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGT") for _ in range(600)) for _ in range(6)]
    (tmp_path / "ref.fa").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)))
    (tmp_path / "reads.fa").write_text("".join(f">r{i}\n{s[50:250]}\n" for i, s in enumerate(seqs)))
    reads = modes.read_queries(spark, [f"{tmp_path}/reads.fa"], "none")
    dbs = {}
    for name, p in {"wide": SketchParams(31), "syncmers": SketchParams(14, sketcher="syncmer")}.items():
        modes.build(spark, [f"{tmp_path}/ref.fa"], params=p).save(f"{tmp_path}/{name}")
        dbs[name] = modes.Database.load(spark, f"{tmp_path}/{name}")
        assert dbs[name].params == p
        names = {x.tgt: x.name for x in dbs[name].targets.select("tgt", "name").collect()}
        best = modes.query(dbs[name], reads).candidates.where("pos = 1").collect()
        assert {x.query_id: names[x.tgt] for x in best} == {i + 1: f"s{i}" for i in range(6)}
    with pytest.raises(ValueError):
        modes.query(dbs["wide"], reads, query_params=SketchParams(14, sketcher="syncmer"))
    store = LayeredIndex.open(spark, f"{tmp_path}/wide")
    store.annotate(store.extra | {"params": store.extra["params"] | {"sketcher": "unheard-of"}})
    with pytest.raises(ValueError):
        modes.Database.load(spark, f"{tmp_path}/wide")
