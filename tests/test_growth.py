"""Work that has to stay whole, and figures that have to stay in proportion, when tables grow."""

import os

import duckdb
import pytest
import sqlcompare
from pyspark.sql import functions as F
from strandline.plans import file_queries, oracle

SF = "/root/testdata/sf0.001"


def test_fastq_records_are_numbered_over_all_files(spark, monkeypatch):
    """As the SQL says, although the reads lie in several files."""
    monkeypatch.setattr(file_queries, "PER_FILE", 7)
    got = sorted(map(tuple, file_queries.QUERIES["read_fastq_records"](spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    assert got == sorted(con.execute(oracle.oracle_sql()["read_fastq_records"]).fetchall())
    assert [r[0] for r in got] == list(range(1, len(got) + 1)) and len(got) > 7


def test_hits_of_a_target_are_one_line(spark, monkeypatch, tmp_path):
    """As the SQL says: all reads of a target in one line, however many; targets and reads by the numbers of their rows, some of
    which are left out or have no letters; and documents whose language or source is not known."""
    from strandline.operators import report

    monkeypatch.setattr(report, "MOST_READS", 3)
    for name in os.listdir(SF):
        if name not in ("documents.parquet", "benchmark.parquet"):
            os.symlink(f"{SF}/{name}", tmp_path / name)
    odd = "CASE {i} % 11 WHEN 3 THEN '' WHEN 5 THEN '12 34' WHEN 7 THEN NULL ELSE text END AS text"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT doc_id + doc_id // 9 * 5 AS doc_id, {odd.format(i='doc_id')}, CASE WHEN doc_id % 13 <> 2 THEN lang END AS lang, CASE WHEN doc_id % 17 <> 4 THEN source END AS source, n_chars FROM '{SF}/documents.parquet' WHERE doc_id < 60) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT 3 * item_id + 2 AS item_id, {odd.format(i='item_id')} FROM '{SF}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet'")
    sqlcompare.check(spark, file_queries.QUERIES["hits_per_target_report"], oracle.oracle_sql()["hits_per_target_report"], str(tmp_path))


def test_buckets_of_layers_grow_with_what_is_indexed(spark, monkeypatch):
    """So that no task's share of a layer grows with the tables."""
    from strandline.operators import layers
    from strandline.operators.layers import Policy
    from strandline.plans import fixtures as fx
    from strandline.plans import queries

    monkeypatch.setattr(layers, "BUCKET_ROWS", 1000)
    store = queries._in_layers(spark, SF, fx.CROWDED, Policy())
    assert len({x["buckets"] for x in store.layers}) == 3 and all(x["buckets"] > 4 and x["rows"] / x["buckets"] < 1000 for x in store.layers)


def test_partitions_that_are_sorted_are_bounded(spark):
    from strandline.storage import spread

    t = spark.read.parquet(f"{SF}/documents.parquet")
    assert spread(t, 1 << 12).rdd.getNumPartitions() > 8 > spread(t).rdd.getNumPartitions()


def test_letters_are_made_once_and_pairs_counted(spark):
    from strandline.functions import dna
    from strandline.plans import fixtures as fx

    plan = fx.targets(spark, SF).where("length(dna) > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "translate" not in plan
    rows = [("AbKİ zé\U0001f600d",), ("",), (None,), ("1 2",), ("eE",)]
    got = spark.createDataFrame(rows, "s string").coalesce(1).select(dna.dna_of(F.col("s")).alias("d")).select("d", dna.pair_counts(F.col("d")).alias("p")).collect()
    assert [r.d for r in got] == ["ACGACT", "", None, "", "AA"]
    assert {k: n for k, n in got[0].p.items() if n} == {"AC": 2, "CG": 1, "GA": 1, "CT": 1} and got[2].p is None
    assert [sum(r.p.values()) for r in got if r.p] == [5, 0, 0, 1]


@pytest.mark.parametrize("k,sketcher", [(4, "minhash"), (6, "syncmer"), (21, "minhash")])
def test_sequences_sketched_side_by_side(spark, k, sketcher):
    import numpy as np
    from strandline.functions import features
    from strandline.operators import sketching
    from strandline.params import SketchParams

    p, rng = SketchParams(k, 5, 32, sketcher=sketcher), np.random.default_rng(k)
    seqs = ["".join(rng.choice(list("ACGTacgtN"), n, p=[0.12] * 8 + [0.04])) for n in (0, 3, 4, 200, 31, 32, 33, 5, 64, 1)] + ["ACGT" * 20]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
    which, win, feature = sketching.sketch_numpy(np.frombuffer("".join(seqs).encode(), dtype=np.uint8), starts, p, features.policy(p))
    d = spark.createDataFrame(list(enumerate(seqs)), "i long, s string")
    want = sorted(tuple(r) for r in sketching.sketch_features(d, "i", "s", p, "sql").collect())
    assert sorted(zip(which.tolist(), win.tolist(), feature.tolist())) == want and len(want) > 10
    assert sorted(tuple(r) for r in sketching.sketch_features(d, "i", "s", p).collect()) == want


def test_common_ancestors_keep_one_row_for_each_pair(spark):
    """Also where pairs come twice or are not known; no step makes a row for each ancestor or reads the pairs a second time."""
    from strandline.operators import intervals, taxonomy
    from strandline.storage import stored

    taxa = spark.createDataFrame([(1, 1, "r", 20), (2, 1, "x", 19), (3, 2, "y", 4), (4, 2, "z", 4), (9, 9, "o", 4)], "taxid long, parent long, name string, rank int")
    rows = [(3, 4, 2), (3, 4, 2), (3, 3, 3), (3, 2, 2), (3, 9, None), (77, 77, None), (3, 77, None), (1, 4, 1)]
    pairs = spark.createDataFrame([r[:2] for r in rows], "a long, b long")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    full = taxonomy.lca_full(pairs, stored(taxonomy.lineages(taxa)))
    labels = intervals.tour(intervals.inner(taxa))
    short = intervals.lowest_common(pairs, taxa, labels, intervals.highest_table(labels))
    for d in (full, short):
        assert sorted(map(key, d.collect())) == sorted(map(key, rows))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(full).count("Join ") == 2 and "Aggregate" not in plan(short)


def test_targets_whose_names_come_twice(spark, tmp_path):
    """Numbers leave none of the first ones out, also where a file's last record is the one that goes."""
    from strandline.plans import modes

    files = {"a": [("s1.1", "AACC"), ("s2.1", "GG"), ("s1.1", "TT")], "b": [("s3.1", "AC"), ("s2.1", "CA"), ("s4.1", "GT")], "c": [("s1.1", "G")], "d": [("s5.1", "T")]}
    for f, records in files.items():
        (tmp_path / f"{f}.part").write_text("".join(f">{h} taxid:{7 + i}\n{s}\n" for i, (h, s) in enumerate(records)))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("names"))
    spark.sparkContext.setJobGroup("names", "")
    try:
        from strandline.sources import sequences

        sequences.read_sequences(spark, str(tmp_path))
        assert jobs() == 0  # files without a known ending are told apart without a job for each
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = {r.name: (r.tgt, r.dna, r.parent) for r in modes.number_targets(spark, [str(tmp_path)], None).collect()}
    assert got == {"s1.1": (0, "AACC", 7), "s2.1": (1, "GG", 8), "s3.1": (2, "AC", 7), "s4.1": (4, "GT", 9), "s5.1": (5, "T", 7)}


@pytest.mark.parametrize("few", [True, False])
def test_lineages_and_estimates_broadcast_inner_taxa_alone(spark, monkeypatch, few):
    """Ids pack so well that a file of all taxa looks small enough to be sent to the driver and from there to all; few: those with
    others below them are proven to be few."""
    from strandline.operators import classify, taxonomy
    from strandline.storage import stored

    if not few:
        monkeypatch.setattr(taxonomy, "bounded_broadcast", lambda df, row_bytes: df)
    n = 40_000
    inner = spark.createDataFrame([(1, 1, 20), (2, 1, 19), (3, 1, 19)], "taxid long, parent long, rank int")
    taxa = stored(inner.unionByName(spark.range(10, n + 10).select(F.col("id").alias("taxid"), (F.col("id") % 2 + 2).alias("parent"), F.lit(4).alias("rank"))))
    counts = stored(taxa.where("taxid <> 1").select("taxid", F.when(F.col("taxid") < 10, n // 2).otherwise(1).cast("long").alias("n")))
    spark.conf.set("spark.sql.maxBroadcastTableSize", 2 << 20)  # all taxa take more, the least that a table takes is 1 MB
    try:
        lin = taxonomy.lineages(taxa)
        assert lin.groupBy("depth").count().count() == 3 and lin.count() == 3 * n + 5
        got = classify.estimate_abundances(counts, lin, 4).groupBy("n").agg(F.count("*"), F.min("taxid"), F.max("taxid")).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [tuple(r) for r in got] == [(2.0, n, 10, n + 9)]
