"""Command line: python -m strandline build|modify|query|merge|info|annotate ... (spark-submit works alike)."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .functions.features import HASHES, SELECTIONS
from .operators import report
from .params import MAX_LOCATIONS, RANKS, ClassifyParams, SketchParams, rank_number
from .plans import modes
from .sources import sequences, taxa


def _rank(name: str) -> int:
    r = rank_number(name)
    if r >= len(RANKS) - 1:
        raise argparse.ArgumentTypeError(f"{name} is no rank")
    return r


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    sub = p.add_subparsers(dest="mode", required=True)

    def sources(q: argparse.ArgumentParser) -> None:
        q.add_argument("database")
        q.add_argument("files", nargs="*")
        q.add_argument("--taxonomy", help="folder with nodes.dmp, names.dmp and merged.dmp")
        q.add_argument("--pre-mapping", nargs="*", default=[], help="assembly summaries")

    q = sub.add_parser("build", help="make a database of sequence files")
    sources(q)
    q.add_argument("--post-mapping", nargs="*", default=[], help="accession mappings, tried in this order")
    q.add_argument("--kmerlen", type=int, default=16)
    q.add_argument("--sketchlen", type=int, default=16)
    q.add_argument("--winlen", type=int, default=128)
    q.add_argument("--winstride", type=int, default=0)
    q.add_argument("--sketcher", default="minhash", choices=sorted(SELECTIONS))
    q.add_argument("--feature-hash", default="", choices=["", *sorted(HASHES)], help="by default one that is wide enough for the k-mers")
    q.add_argument("--max-locations-per-feature", type=int, default=MAX_LOCATIONS)
    q.add_argument("--remove-overpopulated-features", action="store_true")
    q.add_argument("--remove-ambig-features", type=_rank)
    q.add_argument("--max-ambig-per-feature", type=int, default=1)
    q = sub.add_parser("modify", help="add sequences or another taxonomy")
    sources(q)
    q.add_argument("--out", help="where the new database is written; without it, the database gets another layer")
    q.add_argument("--post-mapping", nargs="*", default=[])
    q.add_argument("--reset-parents", action="store_true")

    def classification(q: argparse.ArgumentParser) -> None:
        q.add_argument("--lowest", type=_rank, default=0)
        q.add_argument("--highest", type=_rank, default=RANKS.index("domain"))
        q.add_argument("--hitmin", type=int, default=0)
        q.add_argument("--hitdiff", type=float, default=1.0)
        q.add_argument("--max-cand", type=int, default=2)
        q.add_argument("--out", required=True)
        q.add_argument("--abundances", help="folder for reads by taxon")
        q.add_argument("--abundance-per", type=_rank, help="with --abundances: bring counts to this rank")

    q = sub.add_parser("query", help="classify reads; without files, read names of files from standard input")
    q.add_argument("database")
    q.add_argument("files", nargs="*")
    classification(q)
    q.add_argument("--pairfiles", action="store_true")
    q.add_argument("--pairseq", action="store_true")
    q.add_argument("--insertsize", type=int, default=0)
    q.add_argument("--query-limit", type=int)
    q.add_argument("--max-locations-per-feature", type=int)
    q.add_argument("--remove-overpopulated-features", action="store_true")
    q.add_argument("--taxon-style", choices=["rank_id", "rank_name", "rank_name_id", "id", "name", "name_id"], default="rank_name")
    q.add_argument("--separator", default="\t|\t")
    q.add_argument("--separate-cols", action="store_true")
    q.add_argument("--comment", default="# ")
    q.add_argument("--mapped", choices=["all", "mapped_only", "none"], default="all")
    q.add_argument("--exclude", type=_rank, help="hide the clade of each read's truth at this rank")
    q.add_argument("--sketchlen", type=int)
    q.add_argument("--winlen", type=int)
    q.add_argument("--winstride", type=int)
    for flag in ("queryids", "tophits", "allhits", "locations", "align", "splitout", "lineage", "ground-truth", "precision", "taxon-coverage", "no-summary", "no-query-params"):
        q.add_argument(f"--{flag}", action="store_true")
    q.add_argument("--hits-per-seq", help="folder for hits by target")
    q = sub.add_parser("merge", help="classify anew from several results")
    q.add_argument("results", nargs="+")
    q.add_argument("--taxonomy", required=True)
    classification(q)
    q = sub.add_parser("info", help="show what a database holds")
    q.add_argument("database")
    q.add_argument("what", nargs="?", default="config")
    q.add_argument("--rank", type=_rank, default=4)
    q = sub.add_parser("annotate", help="put taxids into sequence headers")
    q.add_argument("file")
    q.add_argument("mapping", nargs="+")
    q.add_argument("--out", required=True)
    q.add_argument("--field-sep", default=" ")
    q.add_argument("--value-sep", default="|")
    q.add_argument("--id", choices=["accver", "acc", "gi"], default="accver")
    return p


def _params(a: argparse.Namespace) -> ClassifyParams:
    return ClassifyParams(a.hitmin, a.hitdiff, a.max_cand, getattr(a, "insertsize", 0), a.lowest, a.highest)


def _window(db: modes.Database, a: argparse.Namespace) -> SketchParams | None:
    """Sketching of reads other than the database's; a window without a stride is its own stride."""
    if not (a.sketchlen or a.winlen or a.winstride):
        return None
    p = db.params
    return replace(p, size=a.sketchlen or p.size, window=a.winlen or p.window, stride=a.winstride or a.winlen or p.stride)


def _query(spark: SparkSession, db: modes.Database, a: argparse.Namespace, files: list[str], out: str) -> None:
    reads = modes.read_queries(spark, files, "files" if a.pairfiles else "sequences" if a.pairseq else "none", a.query_limit)
    top = a.tophits or a.allhits
    fmt = report.Format(column=a.separator, comment=a.comment, taxon=a.taxon_style, mapped=a.mapped if not top else "all" if a.mapped == "none" else a.mapped, query_ids=a.queryids or bool(a.hits_per_seq), top_hits=a.tophits, all_hits=a.allhits, locations=a.locations, lineage=a.lineage, truth=a.ground_truth, lowest=a.lowest, highest=a.highest, separate=a.separate_cols)
    began = time.time()
    c = _params(a).resolved(db.params.size)
    res = modes.query(db, reads, _params(a), fmt, a.max_locations_per_feature, a.remove_overpopulated_features, a.exclude, None, _window(db, a), a.precision or a.taxon_coverage, a.taxon_coverage)
    pairing = "files" if a.pairfiles else "sequences" if a.pairseq else "none"
    head = None if a.no_query_params else report.parameter_lines(fmt, c, pairing, a.exclude, a.align, bool(a.hits_per_seq), a.abundance_per)
    tail = None
    if not a.no_summary:
        n = reads.count()
        speed = report.speed_lines(n, time.time() - began, pairing, fmt)
        tail = spark.createDataFrame([(i - len(speed), x) for i, x in enumerate(speed)], "pos int, line string").unionByName(report.summary_lines(res.rates, fmt)).orderBy("pos")
    modes.write_lines(res, out, c, reads if a.splitout else None, head, tail)
    if res.coverage is not None:
        res.coverage.write.mode("overwrite").parquet(f"{out}-coverage")
    if a.align:
        modes.alignments(db, res, reads).write.mode("overwrite").parquet(f"{out}-alignments")
    if a.hits_per_seq:
        windows = dna.window_count(F.length("dna"), db.params).alias("windows")
        lines = report.hits_per_target_lines(res.hits, db.targets.select("tgt", "taxid", windows), res.arrays, db.all_taxa(), fmt)
        lines.sortWithinPartitions("tgt", "pos").select("line").write.mode("overwrite").text(a.hits_per_seq)
    if a.abundances:
        found = report.abundance_lines(modes.abundance_of(res, db, a.abundance_per), db.all_taxa(), fmt)
        found.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(a.abundances)


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """Does what the arguments say; info gives its table."""
    a = parser().parse_args(argv)
    if a.mode == "build":
        p = SketchParams(a.kmerlen, a.sketchlen, a.winlen, a.winstride, a.sketcher, a.feature_hash)
        modes.build(spark, a.files, a.taxonomy, a.pre_mapping, a.post_mapping, p, a.max_locations_per_feature, a.remove_overpopulated_features, a.remove_ambig_features, a.max_ambig_per_feature).save(a.database)
    elif a.mode == "modify":
        if a.out and a.out.rstrip("/") == a.database.rstrip("/"):
            raise SystemExit("modify: --out must not be the database that is read")
        db = modes.Database.load(spark, a.database)
        modes.modify(spark, db.save(a.out) if a.out else db, a.files, a.taxonomy, a.pre_mapping, a.post_mapping, a.reset_parents)
    elif a.mode == "query":
        db = modes.Database.load(spark, a.database)
        if a.files:
            _query(spark, db, a, a.files, a.out)
        for n, line in enumerate([] if a.files else iter(sys.stdin.readline, "")):  # the database stays loaded between lines
            names = line.split()
            if not names or names[0] == ":q":
                break
            if not names[0].startswith("#"):
                _query(spark, db, a, names, f"{a.out}-{n}")
    elif a.mode == "merge":
        tax = taxa.read_taxonomy(spark, a.taxonomy)
        done = modes.merge(spark, a.results, tax, _params(a))
        named = done.join(tax.select("taxid", "name"), "taxid", "left")
        fmt = report.Format(taxon="rank_name_id")
        named.select(F.concat_ws(fmt.column, F.col("query_id").cast("string"), report.taxon_text(F.col("taxid"), F.col("name"), F.col("rank"), fmt)).alias("line")).write.mode("overwrite").text(a.out)
    elif a.mode == "info":
        return modes.info(modes.Database.load(spark, a.database), a.what, a.rank)
    elif a.mode == "annotate":
        rows = None
        for path in taxa.post_mapping_files(a.mapping):
            m = taxa.read_mapping(spark, path)
            rows = m if rows is None else rows.unionByName(m)
        done = modes.annotate(sequences.read_lines(spark, a.file), rows, a.id, a.field_sep, a.value_sep)
        done.orderBy("index").select("value").write.mode("overwrite").text(a.out)
    return None


if __name__ == "__main__":
    shown = run(SparkSession.builder.appName("strandline").getOrCreate(), sys.argv[1:])
    if shown is not None:
        shown.show(1000, truncate=False)
