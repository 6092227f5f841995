"""Readers, writers and modes on generated files."""

import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import report
from strandline.params import ClassifyParams, SketchParams
from strandline.plans import modes
from strandline.sources import sequences, taxa

NODES = "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n7\t|\t2\t|\tgenus\t|\n8\t|\t7\t|\tspecies\t|\n9\t|\t7\t|\tspecies group\t|\n10\t|\t900\t|\tspecies\t|\n"
NAMES = "1\t|\troot\t|\t\t|\tscientific name\t|\n7\t|\tcommon\t|\t\t|\tcommon name\t|\n7\t|\tGenus\t|\t\t|\tscientific name\t|\n8\t|\tSpecies a\t|\t\t|\tscientific name\t|\n2\t|\tOnly\t|\t\t|\tsynonym\t|\n"
MERGED = "900\t|\t8\t|\n"


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d, r = tmp_path_factory.mktemp("files"), random.Random(1)
    (d / "tax").mkdir()
    for name, text in (("nodes", NODES), ("names", NAMES), ("merged", MERGED)):
        (d / "tax" / f"{name}.dmp").write_text(text)
    seqs = [dna(r, 900) for _ in range(4)]
    wrapped = lambda s: "\n".join(s[i : i + 70] for i in range(0, len(s), 70))
    (d / "ref").mkdir()
    (d / "ref" / "a.fa").write_text(f">NC_1.1 first taxid:8 x\n{wrapped(seqs[0])}\n>NC_2.1 second\r\n{wrapped(seqs[1])}\n>NC_1.1 again\nACGT\n")
    (d / "ref" / "b.fna").write_text(f">X_3 third taxid:10\n{seqs[2]}\n")
    (d / "more.fasta").write_text(f">NC_9.1 new taxid:8\n{seqs[3]}\n")
    (d / "summary.txt").write_text("# a comment\n# assembly_accession\tname\ttaxid\nNC_2.1\tx\t8\nNC_2.1\tx\t7\n")
    (d / "map.accession2taxid").write_text("accession\taccession.version\ttaxid\tgi\nX_3\tX_3.1\t7\t5\n")
    (d / "r1.fq").write_text("".join(f"@read{i} mate\n{seqs[i][100:250]}\n+\n{'I' * 150}\n" for i in range(3)) + "\n")
    (d / "r2.fq").write_text("".join(f"@read{i} mate\n{seqs[i][300:450]}\n+\n{'I' * 150}\n" for i in range(2)))
    return d, seqs


def test_readers(spark, files):
    d, seqs = files
    fa = {(r.file.rsplit("/", 1)[1], r["index"]): (r.header, r.data) for r in sequences.read_fasta(spark, f"{d}/ref").collect()}
    assert fa["a.fa", 1] == ("NC_1.1 first taxid:8 x", seqs[0]) and fa["a.fa", 2] == ("NC_2.1 second", seqs[1])
    assert fa["a.fa", 3] == ("NC_1.1 again", "ACGT") and fa["b.fna", 1][1] == seqs[2]
    fq = sorted((r["index"], r.header, r.data, len(r.qualities)) for r in sequences.read_fastq(spark, f"{d}/r1.fq").collect())
    assert fq == [(i + 1, f"read{i} mate", seqs[i][100:250], 150) for i in range(3)]
    heads = sequences.read_headers(spark, f"{d}/ref/a.fa").collect()
    assert sorted((r["index"], r.header) for r in heads)[0] == (1, "NC_1.1 first taxid:8 x")
    assert sequences.read_sequences(spark, f"{d}/ref", f"{d}/r1.fq").count() == 7


def test_bad_files_raise(spark, tmp_path):
    for name, text, read in (("a.fa", "no header\nACGT\n", sequences.read_fasta), ("b.fa", ">x\n>y\nACGT\n", sequences.read_fasta), ("c.fq", "@x\nACGT\nIIII\n", sequences.read_fastq)):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=name):
            read(spark, f"{tmp_path}/{name}").collect()
    assert sequences.format_of("x.FQ") == "fastq" and sequences.format_of("x.dat", ">a") == "fasta"
    with pytest.raises(sequences.FormatError):
        sequences.format_of("x.dat", "z")


def test_taxonomy_dumps(spark, files):
    t = {r.taxid: (r.parent, r.name, r["rank"]) for r in taxa.read_taxonomy(spark, f"{files[0]}/tax").collect()}
    assert t == {1: (1, "root", 20), 2: (1, "Only", 19), 7: (2, "Genus", 6), 8: (7, "Species a", 4), 9: (7, "--", 5), 10: (8, "--", 4), 900: (8, "", 21)}
    m = {r["key"]: r.taxid for r in taxa.read_assembly_summary(spark, f"{files[0]}/summary.txt").collect()}
    assert m == {"NC_2.1": 8}
    names = ["d/x.accession2taxid", "d/nucl_wgs.accession2taxid", "d/nucl_gb.accession2taxid"]
    assert taxa.post_mapping_files(names, ["own"]) == ["own", names[2], names[1], names[0]]


@pytest.fixture(scope="module")
def database(spark, files):
    d, _ = files
    return modes.build(spark, [f"{d}/ref"], f"{d}/tax", [f"{d}/summary.txt"], [f"{d}/map.accession2taxid"], SketchParams(12))


def test_build_save_load(spark, files, database, tmp_path):
    t = {r.tgt: (r.name, r.parent) for r in database.targets.collect()}
    assert t == {0: ("NC_1.1", 8), 1: ("NC_2.1", 8), 3 if 3 in t else 2: ("X_3 third taxid:10", 10)}
    database.save(f"{tmp_path}/db")
    again = modes.Database.load(spark, f"{tmp_path}/db")
    assert again.params == database.params and again.features.count() == database.features.count()
    assert modes.Database.load(spark, f"{tmp_path}/db", metadata_only=True).features is None


def test_query_report_and_merge(spark, files, database, tmp_path):
    d, _ = files
    reads = modes.read_queries(spark, [f"{d}/r1.fq", f"{d}/r2.fq"], "files")
    assert reads.count() == 2
    c = ClassifyParams(lowest=4)
    f = report.Format(query_ids=True, top_hits=True, lowest=4)
    res = modes.query(database, reads, c, f)
    assert [r.taxid for r in res.classified.orderBy("query_id").collect()] == [8, 8]
    assert modes.alignments(database, res, reads).where("score > 100").count() == 2
    modes.write_lines(res, f"{tmp_path}/out", c)
    merged = modes.merge(spark, [f"{tmp_path}/out"], database.all_taxa(), c).collect()
    assert {r.query_id: r.taxid for r in merged} == {1: 8, 2: 8}
    assert modes.abundance_of(res, database).first().percent == 100.0
    assert modes.abundance_of(res, database, 4).first().n == 2.0
    modes.write_lines(res, f"{tmp_path}/split", c, reads)
    assert sorted(r.value.split("\t")[0] for r in spark.read.text(f"{tmp_path}/split").collect())[2:] == ["1", "2"]
    assert {r.query_id: r.taxid for r in modes.merge(spark, [f"{tmp_path}/split/file=r1.fq"], database.all_taxa(), c).collect()} == {1: 8, 2: 8}
    single = modes.read_queries(spark, [f"{d}/r1.fq", f"{d}/r2.fq"], limit=1)
    assert sorted(r.query_id for r in single.collect()) == [1, 2]
    assert modes.read_queries(spark, [f"{d}/r1.fq"], "sequences").count() == 1
    hidden = modes.query(database, reads, c, f, exclude_rank=4, truth=spark.createDataFrame([(1, 8), (2, 8)], "query_id long, truth_taxid long"))
    assert all(r.taxid != 8 for r in hidden.classified.collect())


def test_modify_and_info(spark, files, database):
    d, _ = files
    more = modes.modify(spark, database, [f"{d}/more.fasta", f"{d}/ref/a.fa"])
    assert more.targets.count() == database.targets.count() + 1
    assert more.features.count() > database.features.count()
    assert modes.modify(spark, database, reset_parents=True).targets.where("parent <> 0").count() == 0
    for what in ("config", "targets", "lineages", "rank", "statistics", "featurecounts", "featuremap"):
        assert modes.info(database, what).count() > 0
    row = modes.info(database, "lineages").where("name = 'NC_1.1'").first()
    assert (row.species, row.genus, row.domain, row.form) == (8, 7, 2, 0)


def test_modify_writes_a_layer_and_equals_one_build(spark, files, tmp_path):
    """With removal on, features that were overpopulated in the first build do not come back; only new files are written."""
    d, _ = files
    p = SketchParams(4, 8, 32)
    build = lambda f: modes.build(spark, f, f"{d}/tax", params=p, max_locations=4, remove_overpopulated=True)
    db = build([f"{d}/ref"]).save(f"{tmp_path}/db")
    before = {x["id"] for x in db.store.layers}
    more = modes.modify(spark, db, [f"{d}/more.fasta", f"{d}/ref"])
    assert more.store.version == db.store.version + 1 and before < {x["id"] for x in more.store.layers}
    named = lambda x: sorted(tuple(r) for r in x.features.join(x.targets, "tgt").select("feature", "name", "win").collect())
    whole = build([f"{d}/ref", f"{d}/more.fasta"])
    assert named(more) == named(whole) and named(more) != named(db)
    # the former version can still be read, and cannot be extended any more
    assert named(db) == named(build([f"{d}/ref"]))
    with pytest.raises(RuntimeError, match="newer version"):
        modes.modify(spark, db, [f"{d}/more.fasta"])
    # a copy is one layer with the same future
    copy = more.save(f"{tmp_path}/copy")
    assert len(copy.store.layers) == 1 and named(copy) == named(whole)


def test_parents_are_given_anew(spark, files, database, tmp_path):
    d, _ = files
    (tmp_path / "m.accession2taxid").write_text("accession\taccession.version\ttaxid\tgi\nNC_1\tNC_1.1\t7\t1\n")
    db = modes.modify(spark, database, reset_parents=True, post_mapping=[f"{tmp_path}/m.accession2taxid"])
    assert {r.name: r.parent for r in db.targets.collect()}["NC_1.1"] == 7
    assert db.targets.where("parent <> 0").count() == 1 and db.features.count() == database.features.count()


def test_annotate(spark, files):
    d, _ = files
    lines = sequences.read_lines(spark, f"{d}/ref/a.fa")
    m = spark.createDataFrame([("f", 1, "NC_1", "NC_1.1", "5", 77), ("f", 2, "NC_1", "NC_1.1", "5", 78)], "file string, row long, acc string, accver string, gi string, taxid long")
    out = [r.value for r in modes.annotate(lines, m).orderBy("index").collect()]
    assert out[0] == ">NC_1.1 taxid|77 first taxid:8 x" and any(x == ">NC_2.1 taxid|0 second" for x in out)
    assert sum(x.startswith(">") for x in out) == 3


def test_streamed_batches_equal_a_table(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", F.coalesce("taxid", F.lit(0)), F.coalesce("rank", F.lit(-1))).collect())
    assert key(q["stream_classify"](spark, "/root/testdata/sf0.001")) == key(q["classify_lca"](spark, "/root/testdata/sf0.001"))


def test_command_line(spark, files, tmp_path, monkeypatch):
    from io import StringIO

    from strandline.__main__ import run

    d, _ = files
    db = f"{tmp_path}/db"
    run(spark, ["build", db, f"{d}/ref", "--taxonomy", f"{d}/tax", "--pre-mapping", f"{d}/summary.txt", "--kmerlen", "12", "--remove-overpopulated-features"])
    assert run(spark, ["info", db]).first().k == 12 and run(spark, ["info", db, "rank", "--rank", "genus"]).count() >= 1
    out = f"{tmp_path}/out"
    run(spark, ["query", db, f"{d}/r1.fq", f"{d}/r2.fq", "--pairfiles", "--queryids", "--tophits", "--lowest", "species", "--out", out, "--abundances", f"{tmp_path}/ab", "--hits-per-seq", f"{tmp_path}/hits", "--align"])
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sum(not x.startswith("#") for x in lines) == 2 and [r.value for r in spark.read.text(f"{tmp_path}/ab").collect()] == ["species:Species a\t|\t2\t|\t100.0%"]
    assert sum(" queries/min" in x for x in lines) == 1 and any(x.startswith("# candidates: 2 at most") for x in lines)
    hits = [r.value for r in spark.read.text(f"{tmp_path}/hits").collect()]
    assert len(hits) == 2 and all(x.startswith("species:Species a\t|\t8\t|\t") for x in hits)
    run(spark, ["merge", out, "--taxonomy", f"{d}/tax", "--lowest", "species", "--out", f"{tmp_path}/merged"])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/merged").collect()) == [f"{i}\t|\tspecies:Species a(8)" for i in (1, 2)]
    run(spark, ["modify", db, f"{d}/more.fasta", "--out", f"{tmp_path}/db2"])
    assert run(spark, ["info", f"{tmp_path}/db2", "targets"]).count() == 4
    run(spark, ["annotate", f"{d}/ref/a.fa", f"{d}/map.accession2taxid", "--out", f"{tmp_path}/an"])
    assert any("taxid|0" in r.value for r in spark.read.text(f"{tmp_path}/an").collect())
    monkeypatch.setattr("sys.stdin", StringIO(f"# note\n{d}/r1.fq\n:q\n"))
    run(spark, ["query", db, "--out", f"{tmp_path}/loop"])
    assert sum(not r.value.startswith("#") for r in spark.read.text(f"{tmp_path}/loop-1").collect()) == 3
    run(spark, ["query", db, f"{d}/r1.fq", "--lowest", "species", "--lineage", "--ground-truth", "--precision", "--taxon-coverage", "--winlen", "64", "--no-query-params", "--out", f"{tmp_path}/truth"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/truth").collect()]
    assert any(x.startswith("# right among those placed") for x in lines) and any("truth_species:truth_taxname,truth_subgenus" in x for x in lines)
    assert sum(x.endswith("species:Species a,subgenus:--,genus:Genus,subtribe:--,tribe:--,subfamily:--,family:--,suborder:--,order:--,subclass:--,class:--,subphylum:--,phylum:--,subkingdom:--,kingdom:--,domain:Only") for x in lines) == 3
    run(spark, ["query", db, f"{d}/r1.fq", "--lowest", "species", "--exclude", "species", "--no-summary", "--separate-cols", "--lineage", "--out", f"{tmp_path}/hidden"])
    with pytest.raises(SystemExit):
        run(spark, ["modify", db, f"{d}/more.fasta", "--out", f"{db}/"])


def test_mappings_are_found_beside_the_files(spark, tmp_path, files):
    d, seqs = files
    (tmp_path / "seq").mkdir()
    (tmp_path / "tax").mkdir()
    for f in ("nodes", "names", "merged"):
        (tmp_path / "tax" / f"{f}.dmp").write_text((d / "tax" / f"{f}.dmp").read_text())
    (tmp_path / "seq" / "a.fa").write_text(f">NC_1.1 x\n{seqs[0]}\n>NC_2.1 y\n{seqs[1]}\n>NC_3.1 z\n{seqs[2]}\n")
    (tmp_path / "seq" / "assembly_summary.txt").write_text("# assembly_accession\ttaxid\nNC_1.1\t8\n")
    (tmp_path / "tax" / "nucl_gb.accession2taxid").write_text("a\tb\tc\td\nNC_2\tNC_2.1\t7\t1\nNC_1\tNC_1.1\t2\t1\n")
    db = modes.build(spark, [f"{tmp_path}/seq"], f"{tmp_path}/tax", params=SketchParams(12))
    assert {r.name: r.parent for r in db.targets.collect()} == {"NC_1.1": 8, "NC_2.1": 7, "NC_3.1": 0}
    with pytest.raises(ValueError, match="3 targets"):
        modes.number_targets(spark, [f"{tmp_path}/seq"], None, most=2)
