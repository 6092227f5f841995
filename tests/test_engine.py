"""The engine's operators against plain sequential models."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.functions import dna, headers
from strandline.operators import align, classify, evaluate, index, matching, naming, report, sketching, taxonomy
from strandline.params import ClassifyParams, SketchParams, merge_params, rank_number


def model_hash(x):
    for _ in range(2):
        x = ((x >> 16 ^ x) * 0x45D9F3B) & 0xFFFFFFFF
    return x >> 16 ^ x


def model_code(kmer):
    return int(kmer.translate(str.maketrans("ACGT", "0123")), 4)


def model_windows(seq, p):
    if len(seq) <= p.window:
        return [seq]
    out, i = [], 0
    while i + p.window <= len(seq):
        out.append(seq[i : i + p.window])
        i += p.stride
    return out + ([seq[i:]] if i < len(seq) else [])


def model_sketch(window, p):
    hashes = set()
    for i in range(len(window) - p.k + 1):
        k = window[i : i + p.k].upper()
        if set(k) <= set("ACGT"):
            rc = k.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            hashes.add(model_hash(model_code(min(k, rc))))
    return sorted(hashes - {0xFFFFFFFF})[: p.size]


LENGTHS = [0, 1, 15, 16, 127, 128, 129, 240, 241, 242, 354, 1000]


@pytest.mark.parametrize("p", [SketchParams(), SketchParams(10), SketchParams(4, 8, 20, 7), SketchParams(8, 3, 16, 16)])
def test_sketches_of_both_engines(spark, p):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ACGTACGTACGTNacgt") for _ in range(n))) for i, n in enumerate(LENGTHS)] + [(90, "N" * 300), (91, "GATTACA" * 30), (92, None)]
    df = spark.createDataFrame(rows, "tgt long, dna string")
    want = sorted((i, w, f) for i, s in rows if s for w, x in enumerate(model_windows(s, p)) for f in model_sketch(x, p))
    for engine in ("sql", "arrow"):
        assert sorted(map(tuple, sketching.sketch_features(df, "tgt", "dna", p, engine).collect())) == want
    windows = sketching.sequence_windows(df, "tgt", "dna", p).collect()
    assert sorted((x.tgt, x.win, x.s) for x in windows) == sorted((i, w, x) for i, s in rows if s for w, x in enumerate(model_windows(s, p)))


def test_long_sequences_are_sketched_in_parts(spark, monkeypatch):
    r = random.Random(9)
    for part in (1, 3):
        monkeypatch.setattr(sketching, "PART_WINDOWS", part)
        for p in (SketchParams(10), SketchParams(4, 8, 20, 7), SketchParams(8, 3, 16, 16), SketchParams(4, 4, 10, 25)):
            rows = [(i, "".join(r.choice("ACGTN") for _ in range(n))) for i, n in enumerate([*LENGTHS, *range(p.window - 1, p.window + 4 * p.stride, 5)])]
            df = spark.createDataFrame(rows, "tgt long, dna string")
            want = sorted((i, w, f) for i, s in rows if s for w, x in enumerate(model_windows(s, p)) for f in model_sketch(x, p))
            assert sorted(map(tuple, sketching.sketch_features(df, "tgt", "dna", p, "arrow").collect())) == want


def test_pairs_of_bases(spark):
    rows = [("",), ("A",), ("AA",), ("AAAA",), ("ACNNGTTTA",), ("".join(random.Random(3).choices("ACGTNa", k=400)),), (None,)]
    for r in spark.createDataFrame(rows, "s string").select("s", dna.pair_counts(F.col("s")).alias("c")).collect():
        own = (r.s or "").upper()
        want = {a + b: sum(own[i : i + 2] == a + b for i in range(len(own))) for a in "ACGT" for b in "ACGT"}
        assert r.s is None or r.c == want


def test_golden_vectors(spark):
    golden = [("AAAAAAAAAAAAAAAA", 0, 0, 0), ("TTTTTTTTTTTTTTTT", 4294967295, 0, 0), ("CCCCCCCCCCCCCCCC", 1431655765, 1431655765, 1070324998), ("ACGTACGTACGTACGT", 454761243, 454761243, 3480792923), ("GATTACAGATTACAGA", 2400336968, 2400336968, 2106225986), ("TTTTTTTTTTTTTTTC", 4294967293, 2147483648, 1029333365)]
    k = F.col("kmer")
    found = spark.createDataFrame([(g[0],) for g in golden], "kmer string").select("kmer", dna.code(k), dna.code(dna.canonical(k)), dna.hash32(dna.code(dna.canonical(k)))).collect()
    assert [tuple(r) for r in found] == golden


def test_reverse_complement_leaves_canonical_kmers(spark):
    s = "".join(random.Random(2).choices("ACGT", k=300))
    d = spark.createDataFrame([(s,)], "s string")
    one, other = (sorted(d.select(F.transform(dna.kmers(x, 9), dna.canonical).alias("k")).first().k) for x in (F.col("s"), dna.reverse_complement(F.col("s"))))
    assert one == other


def test_caps_and_filters(spark):
    rows = [(1, t, w) for t in range(100) for w in range(3)] + [(2, t, 0) for t in range(253)] + [(3, 7, w) for w in range(254)] + [(4, 1, 1), (4, 2, 1)]
    ix = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "feature long, tgt long, win int")
    capped = {f: [] for f in (1, 2, 3, 4)}
    for r in index.cap_locations(ix).collect():
        capped[r.feature].append((r.tgt, r.win))
    assert sorted(capped[1]) == [(t, w) for t in range(100) for w in range(3)][:254] and len(capped[3]) == 254
    assert {r.feature for r in index.remove_overpopulated(ix).collect()} == {2, 4}
    anc = spark.createDataFrame([(t, t % 2) for t in range(300) if t != 2], "tgt long, anc long")
    assert {r.feature for r in index.remove_ambiguous(ix, anc).collect()} == {3}
    assert {r.feature for r in index.remove_ambiguous(ix, anc, 2).collect()} == {1, 2, 3, 4}


def test_moments(spark):
    r = random.Random(3)
    x = [r.expovariate(1) for _ in range(200)]
    m = index.moments(spark.createDataFrame([(v,) for v in x], "v double"), "v").first()
    n, mean = len(x), sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x) / (n - 1)
    assert m.stddev == pytest.approx(math.sqrt(var))
    assert m.skewness == pytest.approx(sum((v - mean) ** 3 for v in x) / n / var**1.5)


def test_best_range_and_candidates(spark):
    r = random.Random(4)
    hits = [(q, t, w, r.randrange(1, 5)) for q in range(6) for t in range(8) for w in sorted(r.sample(range(15), r.randrange(1, 9)))]
    span = {q: r.randrange(1, 5) for q in range(6)}
    best = {}
    for q in range(6):
        for t in range(8):
            own = [(w, c) for a, b, w, c in hits if (a, b) == (q, t)]
            scored = [(sum(c for w, c in own if e - span[q] < w <= e), -e, min(w for w, c in own if e - span[q] < w <= e)) for e, _ in own]
            h, e, b = max(scored, key=lambda x: (x[0], x[1]))
            best[q, t] = (b, -e, h)
    spans = spark.createDataFrame(list(span.items()), "query_id long, span int")
    found = matching.best_window_range(spark.createDataFrame(hits, "query_id long, tgt long, win int, hits long"), spans)
    assert {(x.query_id, x.tgt): (x.beg, x.end, x.hits) for x in found.collect()} == best
    top = matching.top_candidates(found, 3).collect()
    want = {(q, i + 1): t for q in range(6) for i, t in enumerate(sorted(range(8), key=lambda t: (-best[q, t][2], t))[:3])}
    assert {(x.query_id, x.pos): x.tgt for x in top} == want
    taxon = spark.createDataFrame([(t, t // 3) for t in range(8)], "tgt long, taxid long")
    for x in matching.top_taxa(found, taxon, 9).collect():
        own = [t for t in range(8) if t // 3 == x.taxid]
        assert x.tgt == min(own, key=lambda t: (-best[x.query_id, t][2], t))


def test_window_span(spark):
    rows = [(1, "A" * 100, "A" * 100), (2, "A" * 150, "A" * 150), (3, "A" * 10, None)]
    reads = spark.createDataFrame(rows, "query_id long, seq1 string, seq2 string")
    assert {r.query_id: r.span for r in matching.window_span(reads, SketchParams()).collect()} == {1: 3, 2: 4, 3: 2}
    assert {r.span for r in matching.window_span(reads.where("query_id = 1"), SketchParams(), 400).collect()} == {5}


TREE = [(1, 1, "root", 20), (2, 1, "d", 19), (9, 2, "f", 10), (20, 9, "g1", 6), (21, 9, "g2", 6), (31, 20, "s1", 4), (32, 20, "s2", 4), (33, 21, "s3", 4), (40, 31, "odd", 21), (-1, 40, "t", 0), (-2, 33, "u", 0), (50, 777, "lost", 4)]


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(TREE, "taxid long, parent long, name string, rank int")


def test_lineages_and_ancestors(spark, tree):
    lin = taxonomy.lineages(tree)
    full = defaultdict(list)
    for r in sorted(lin.collect(), key=lambda r: r.depth):
        full[r.taxid].append(r.anc)
    assert full[-1] == [-1, 40, 31, 20, 9, 2, 1] and full[50] == [50] and full[1] == [1]
    ranks = {r.taxid: r.ranks for r in taxonomy.ranked_arrays(lin).collect()}
    assert ranks[-1][0] == -1 and ranks[-1][4] == 31 and ranks[-1][20] == 1 and ranks[-1][21 - 1] == 1 and ranks[-1][1] is None
    nxt = {r.taxid: r.anc for r in taxonomy.next_ranked(lin, tree).collect()}
    assert nxt[-1] == 31 and nxt[40] == 31 and nxt[20] == 20
    pairs = spark.createDataFrame([(-1, -2), (31, 32), (50, 1), (31, 31)], "a long, b long")
    assert {(r.a, r.b): r.lca for r in taxonomy.lca_full(pairs, lin).collect()} == {(-1, -2): 9, (31, 32): 20, (50, 1): None, (31, 31): 31}
    assert {(r.a, r.b): (r.lca, r.rank) for r in taxonomy.lca_ranked(pairs, lin).collect()} == {(-1, -2): (9, 10), (31, 32): (20, 6), (50, 1): (None, None), (31, 31): (31, 4)}
    assert {r.taxid: r.n for r in taxonomy.covered(lin).collect()}[9] == 2


def test_tree_edits(spark, tree):
    new = spark.createDataFrame([(31, 9, "moved", 4), (99, 1, "new", 4)], tree.schema)
    out = {r.taxid: r for r in taxonomy.insert_or_replace(tree, new).collect()}
    assert out[31].parent == 9 and out[99].name == "new" and len(out) == len(TREE) + 1
    assert all(r.rank <= 6 for r in taxonomy.erase_above(tree, 6).collect())
    p = spark.createDataFrame([(33, 20)], "taxid long, new_parent long")
    assert {r.taxid: r.parent for r in taxonomy.reset_parents(tree, p).collect()}[33] == 20


def run_classify(spark, tree, cands, **kw):
    rows = [(q, i + 1, t, h) for q, c in enumerate(cands) for i, (t, h) in enumerate(c)]
    df = spark.createDataFrame(rows, "query_id long, pos int, taxid long, hits long")
    out = classify.classify(df, taxonomy.ranked_arrays(taxonomy.lineages(tree)), ClassifyParams(hits_min=5, **kw).resolved())
    return [r.taxid for r in out.orderBy("query_id").collect()]


def test_classification_thresholds(spark, tree):
    cands = [[(31, 4)], [(31, 5), (32, 1)], [(31, 12), (32, 8)], [(31, 12), (32, 7)], [(31, 12), (33, 8)], [(31, 9), (50, 9)]]
    assert run_classify(spark, tree, cands) == [None, 20, 20, 31, 9, None]
    assert run_classify(spark, tree, cands[2:4], hits_diff=0.8) == [20, 20]
    assert run_classify(spark, tree, [[(31, 12), (33, 9)]], highest=6) == [None]
    assert run_classify(spark, tree, [[(1, 50)]]) == [None]
    p = ClassifyParams(hits_diff=80, max_candidates=0)
    assert p.resolved(16).hits_min == 5 and p.resolved(5).hits_min == 2 and p.resolved(3).hits_min == 1 and p.resolved().hits_diff == 0.8 and p.resolved().max_candidates > 10**9
    assert merge_params(p).hits_min == 5 and merge_params(p).lowest == 4


def test_abundance_estimation(spark, tree):
    counts = spark.createDataFrame([(31, 60), (32, 20), (20, 10), (9, 15), (33, 20), (None, 7)], "taxid long, n long")
    lin = taxonomy.lineages(tree)
    species = {r.taxid: round(r.n, 4) for r in classify.estimate_abundances(counts, lin, 4).collect()}
    assert species == {31: 76.7045, 32: 25.5682, 33: 22.7273}
    genus = {r.taxid: round(r.n, 4) for r in classify.estimate_abundances(counts, lin, 6).collect()}
    assert genus == {20: 102.2727, 21: 22.7273}
    c = spark.createDataFrame([(1, 31, 4), (2, 31, 4), (3, None, None), (4, 9, 10)], "query_id long, taxid long, rank int")
    assert {r.taxid: (r.n, r.percent) for r in classify.abundances(c).collect()} == {31: (2, 50.0), 9: (1, 25.0), None: (1, 25.0)}


def test_statistics_by_rank(spark, tree):
    cls = spark.createDataFrame([(1, 31, 4), (2, 32, 4), (3, None, None), (4, 9, 10)], "query_id long, taxid long, rank int")
    truth = spark.createDataFrame([(1, 31), (2, 33), (3, 31), (4, None)], "query_id long, truth_taxid long")
    st = {r["rank"]: r for r in evaluate.rates(evaluate.statistics(cls, truth, taxonomy.lineages(tree))).collect()}
    assert (st[4].assigned, st[4].known, st[4].correct, st[4].wrong) == (2, 3, 1, 1)
    assert (st[10].assigned, st[10].known, st[10].correct, st[10].wrong) == (3, 3, 2, 0)
    assert (st[21].assigned, st[21].known) == (1, 1) and st[4].precision == 0.5
    cov = spark.createDataFrame([(9,), (31,)], "taxid long")
    x = {r["rank"]: (r.tp, r.fp, r.tn, r.fn) for r in evaluate.coverage_confusion(cls, truth, taxonomy.lineages(tree), cov).collect()}
    assert x[4] == (1, 1, 0, 1) and x[10] == (2, 0, 0, 1)


def test_headers(spark):
    cases = [("NC_000913.3 Escherichia", "NC_000913.3", "NC_000913"), ("gi|12345|ref|NZ_AB1.1| x", "NZ_AB1.1", "NZ_AB1"), ("contig1", "", ""), ("x.1 rest", "x.1", ""), ("GCF_1-x_y.3|z", "GCF_1-x_y.3", "GCF_1-x_y"), ("AE5", "", "AE5"), ("", "", "")]
    h = F.col("h")
    found = spark.createDataFrame([(c[0],) for c in cases], "h string").select("h", headers.accession_version(h), headers.accession(h)).collect()
    assert [tuple(r) for r in found] == cases
    taxids = [("a taxid|9606 b", 9606), ("taxid|12", 12), ("taxid|7|x y", 7), ("taxid x", 0), ("none", 0)]
    found = spark.createDataFrame([(c[0],) for c in taxids], "h string").select("h", headers.taxon_id(h)).collect()
    assert [tuple(r) for r in found] == taxids
    lines = [(">id one", 5, ">id taxid|5 one"), (">id", 5, ">id taxid|5 "), (">id taxid|9 two", 5, ">id taxid|5 two"), (">id x", None, ">id x")]
    found = spark.createDataFrame([c[:2] for c in lines], "h string, t long").select("h", "t", headers.annotated(h, F.col("t"))).collect()
    assert [tuple(r) for r in found] == lines


def test_names_and_mappings(spark):
    names = spark.createDataFrame([("ab",), ("abc",), ("abcd",), ("b",), (None,)], "name string")
    wanted = spark.createDataFrame([("a",), ("ab",), ("abcd",), ("x",), ("",), (None,)], "acc string")
    assert {r.acc: r.similar for r in naming.similar_names(wanted, names).collect()} == {"a": "ab", "ab": "abc", "abcd": None, "x": None}
    t = spark.createDataFrame([(0, "N1.1", 0), (1, "N2", 0), (2, "77", 0), (3, "N3.1", 5)], "tgt long, name string, parent long")
    rows = [(0, 1, "N1", "N1.1", "1", 11), (0, 2, "N1", "N1.1", "1", 12), (0, 3, "N", "Q.1", "77", 13), (1, 1, "Z", "Z.1", "77", 14), (0, 9, "N3", "N3.1", "3", 15)]
    found = naming.rank_unranked(t, spark.createDataFrame(rows, "file long, row long, acc string, accver string, gi string, taxid long"))
    assert {r.tgt: r.parent for r in found.collect()} == {0: 11, 2: 14}


def test_ranks_and_report(spark, tree):
    assert rank_number("Superkingdom") == 19 and rank_number("species group") == 5 and rank_number("clade") == 21 and rank_number(None) == 21
    reads = spark.createDataFrame([(1, "r1 x"), (2, "r2")], "query_id long, header string")
    cls = spark.createDataFrame([(1, 31, 4)], "query_id long, taxid long, rank int")
    f = report.Format(query_ids=True, taxon="rank_name_id")
    lines = {r.query_id: r.line for r in report.mapping_lines(cls, reads, tree, f).collect()}
    assert lines == {1: "1\t|\tr1\t|\tspecies:s1(31)", 2: "2\t|\tr2\t|\t--"}
    assert report.layout_line(f) == "# TABLE_LAYOUT: query_id\t|\tquery_header\t|\trank:taxname(taxid)"


def test_partitions_do_not_matter(spark):
    r = random.Random(6)
    seqs = [(i, "".join(r.choice("ACGT") for _ in range(400))) for i in range(12)]
    reads = [(i, f"r{i}", seqs[i % 12][1][50:200], "") for i in range(8)]
    p = SketchParams(10)
    results = []
    for n in (1, 4, 16):
        ix = index.cap_locations(index.build_index(spark.createDataFrame(seqs, "tgt long, dna string").repartition(n), p))
        rd = spark.createDataFrame(reads, "query_id long, header string, seq1 string, seq2 string").repartition(n)
        hits = matching.probe(sketching.read_features(rd, p), ix)
        results.append(sorted(map(tuple, matching.top_candidates(matching.best_window_range(hits, matching.window_span(rd, p)), 3).collect())))
    assert results[0] == results[1] == results[2]


def test_similar_names_against_plain_search(spark):
    """Few letters, so that many names continue each other; names equal to what is sought; one prefix that most names have."""
    import random

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab_é") for _ in range(rng.randint(1, n)))
    names = sorted({word(7) for _ in range(400)} | {f"NC_{i:05d}" for i in range(600)})
    accs = sorted({word(5) for _ in range(200)} | set(names[::50]) | {"NC_", "NC_0001", "N", "zz", "NC_00599"})
    found = naming.similar_names(spark.createDataFrame([(a,) for a in [*accs, *accs, None, ""]], "acc string"), spark.createDataFrame([(n,) for n in [*names, *names[:9], None]], "name string"))
    want = {a: min((n for n in names if n.startswith(a) and n != a), key=str.encode, default=None) for a in accs}
    assert {r.acc: r.similar for r in found.collect()} == want
    assert found.count() == len(want)
    none = spark.createDataFrame([], "name string")
    assert [tuple(r) for r in naming.similar_names(spark.createDataFrame([("a",)], "acc string"), none).collect()] == [("a", None)]
