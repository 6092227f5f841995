"""The engine's modes of use: build, modify, query, merge, info and annotate."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers
from ..functions.features import policy
from ..operators import align, classify, evaluate, index, matching, naming, report, sketching, taxonomy
from ..operators.layers import LayeredIndex, Policy, bucket_number
from ..params import MAX_LOCATIONS, RANKS, ClassifyParams, SketchParams
from ..sources import sequences, taxa
from ..storage import bounded_broadcast, shared_dir, spread, stored


#: Version of the stored layout.
LAYOUT = 2


@dataclass
class Database:
    """taxa (taxid, parent, name, rank), targets (tgt, name, taxid, parent, dna, file, index), features (feature, tgt, win).

    located: all locations, of which policy makes features; a database that is stored has its index in store instead.
    """

    taxa: DataFrame
    targets: DataFrame
    features: DataFrame | None
    params: SketchParams
    policy: Policy = Policy()
    located: DataFrame | None = None
    store: LayeredIndex | None = None

    def save(self, path: str) -> Database:
        """Stores the database at path, as its next version if there is one, and gives the stored one."""
        spark = self.taxa.sparkSession
        extra = {"layout": LAYOUT, "params": asdict(self.params), "taxa": _written(self.taxa, f"{path}/taxa"), "targets": [_written(self.targets, f"{path}/targets")]}
        rows = self.located if self.located is not None else self.store.rows() if self.store else self.features
        LayeredIndex.create(spark, path, rows, self.policy, index_buckets(self.targets, self.params), extra)
        return Database.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str, metadata_only: bool = False) -> Database:
        """The last version of a stored database; ValueError if it has another layout or a sketcher or hash that is not known here."""
        store = LayeredIndex.open(spark, path)
        d = store.extra
        if d.get("layout") != LAYOUT:
            raise ValueError(f"{path} has another layout")
        tax, targets = spark.read.parquet(f"{path}/taxa/{d['taxa']}"), spark.read.parquet(*(f"{path}/targets/{t}" for t in d["targets"]))
        features = None if metadata_only else store.rows(tombstones=False)
        params = SketchParams(**d["params"])
        policy(params)
        return Database(tax, targets, features, params, store.policy, None, store)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The index's rows of wanted (feature, distinct). A stored index stays where it lies."""
        if self.store is not None:
            return self.store.lookup(wanted)
        return self.features.join(bounded_broadcast(wanted, 16), "feature", "left_semi")

    def all_taxa(self) -> DataFrame:
        """The taxonomy and the targets, which are taxa of rank sequence with ids below 0."""
        own = self.targets.select("taxid", "parent", "name", F.lit(0).alias("rank"))
        return self.taxa.select("taxid", "parent", "name", "rank").unionByName(own)


def _written(df: DataFrame, folder: str) -> str:
    """Writes df below folder under a name of its own, which is given."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{name}")
    return name


def index_buckets(targets: DataFrame, p: SketchParams) -> int:
    """Buckets for the index of targets: a window has at most p.size features."""
    return bucket_number(targets.agg(F.sum(F.length("dna")).alias("n")).first()["n"], p)


def _dealt(written: DataFrame) -> DataFrame:
    """A table that Spark has written in parts of like sizes, dealt out anew only if they are fewer than half of the cores."""
    return written if 2 * len(written.inputFiles()) >= written.sparkSession.sparkContext.defaultParallelism else spread(written)


#: As many targets as numbers of them fit in 32 bits.
MOST_TARGETS = 2**32 - 1


def number_targets(spark: SparkSession, paths: list[str], mapping: DataFrame | None, first: int = 0, most: int = MOST_TARGETS) -> DataFrame:
    """Targets of sequence files: numbered in the order of files and records, named by accession, with a parent taxon.

    Files named as assembly summaries are no sequences. ValueError if there are more than most targets.
    """
    paths = [f for p in paths for f in sequences.list_files(spark, p) if not f.endswith(taxa.SUMMARY_NAME)]
    s = sequences.read_sequences(spark, *paths).withColumn("name", headers.sequence_id(F.col("header")))
    s = stored(s.withColumnRenamed("data", "dna"), "sequences")
    # names are compared without the sequences, which move once, to their parents
    own = s.select("file", "index", "header", "name", F.substring("dna", 1, 1).alias("dna"))
    own = stored(index.unique_targets(own, ["file", "index"]).drop("dna"), "names")
    # numbers by file: files are few, so their sizes are added up on one row each
    size = own.groupBy("file").agg(F.max("index").alias("n")).orderBy("file").collect()
    before, total = [], first
    for r in size:
        before.append((r.file, total, r.n))
        total += r.n
    if total > most:
        raise ValueError(f"{total} targets, of which there may be {most}")
    at = F.broadcast(spark.createDataFrame(before or [("", 0, 0)], "file string, before long, n long"))
    numbered = lambda d: d.join(at, "file").where("index <= n").withColumn("tgt", F.col("before") + F.col("index") - 1)
    if mapping is None:
        mapping = spark.createDataFrame([], "key string, taxid long")
    file_id = headers.accession_version(headers.file_name(F.col("file")))
    ids = numbered(own).select("tgt", F.col("name").alias("seq_id"), F.when(file_id != "", file_id).otherwise(headers.file_name(F.col("file"))).alias("file_id"), headers.taxon_id(F.col("header")).alias("header_taxid"))
    parents = naming.resolve_parents(ids, mapping)
    return numbered(s).join(parents, "tgt").select("tgt", "name", (-F.col("tgt") - 1).alias("taxid"), "parent", "dna", "file", "index")


def build(spark: SparkSession, paths: list[str], taxonomy_dir: str | None = None, pre_mapping: list[str] = (), post_mapping: list[str] = (), params: SketchParams = SketchParams(), max_locations: int = MAX_LOCATIONS, remove_overpopulated: bool = False, ambiguous_rank: int | None = None, max_ambiguous: int = 1) -> Database:
    """A database of sequence files (FASTA, FASTQ or folders of them).

    Mappings are those given, then those found: assembly summaries beside the sequence files, and accession mappings in the
    taxonomy folder, which only rank targets that are still without a taxon.
    """
    pre_mapping = [*pre_mapping, *(f for f in taxa.summary_files(spark, paths) if f not in pre_mapping)]
    if taxonomy_dir:
        post_mapping = [*post_mapping, *(f for f in taxa.mapping_files(spark, taxonomy_dir) if f not in post_mapping)]
    tax = taxa.read_taxonomy(spark, taxonomy_dir) if taxonomy_dir else spark.createDataFrame([(1, 1, "root", 20)], "taxid long, parent long, name string, rank int")
    mapping = None
    for path in pre_mapping:
        m = taxa.read_assembly_summary(spark, path)
        mapping = m if mapping is None else mapping.unionByName(m)
    targets = number_targets(spark, paths, mapping)
    targets = stored(_ranked_by(spark, targets, post_mapping), "targets")
    db = Database(tax, targets, None, params, Policy(max_locations, remove_overpopulated))
    db.located = without_ambiguous(index.build_index(_dealt(targets), params), db, ambiguous_rank, max_ambiguous)
    db.features = db.policy.settle(db.located).where("tgt is not null")
    return db


def without_ambiguous(features: DataFrame, db: Database, ambiguous_rank: int | None, max_ambiguous: int) -> DataFrame:
    """Features without those found in several taxa of a rank, where that is wanted."""
    if ambiguous_rank is None:
        return features
    own = db.targets.select("tgt", "taxid")
    if ambiguous_rank == 0:
        anc = own.select("tgt", F.col("taxid").alias("anc"))
    else:
        anc = own.join(taxonomy.ancestor_at(taxonomy.lineages(db.all_taxa()), ambiguous_rank), "taxid", "left").select("tgt", "anc")
    return index.remove_ambiguous(features, anc, max_ambiguous)


def _ranked_by(spark: SparkSession, targets: DataFrame, mappings: list[str]) -> DataFrame:
    """Targets that are without a taxon get the one that accession mappings have for them; earlier mappings count first."""
    for path in mappings:
        found = naming.rank_unranked(targets, taxa.read_mapping(spark, path)).withColumnRenamed("parent", "found")
        targets = targets.join(found, "tgt", "left").withColumn("parent", F.coalesce("found", "parent")).drop("found")
    return targets


def modify(spark: SparkSession, db: Database, paths: list[str] = (), taxonomy_dir: str | None = None, pre_mapping: list[str] = (), post_mapping: list[str] = (), reset_parents: bool = False) -> Database:
    """The next version of db, with more sequences or another taxonomy; sequences whose names are there already are left out.

    Only what is new is written: one layer of the index and the new targets (all targets where their parents change). What
    was removed as overpopulated stays away, so that the result is that of one build of all files. A database that is not
    stored yet is stored in the shared folder first. reset_parents: all targets lose their taxa, which mappings give anew.
    """
    db = db if db.store is not None else db.save(f"{shared_dir(spark)}/database-{uuid.uuid4().hex}")
    path, extra, store = db.store.path, dict(db.store.extra), db.store
    if taxonomy_dir:
        extra["taxa"] = _written(taxonomy.insert_or_replace(db.taxa, taxa.read_taxonomy(spark, taxonomy_dir)), f"{path}/taxa")
    mapping = None
    for m in (taxa.read_assembly_summary(spark, f) for f in pre_mapping):
        mapping = m if mapping is None else mapping.unionByName(m)
    if reset_parents or post_mapping:
        old = db.targets.withColumn("parent", F.lit(0).cast("long")) if reset_parents else db.targets
        extra["targets"] = [_written(_ranked_by(spark, old, post_mapping), f"{path}/targets")]
    if paths:
        first = db.targets.agg(F.coalesce(F.max("tgt") + 1, F.lit(0)).alias("n")).first()["n"]
        new = number_targets(spark, list(paths), mapping, first).join(db.targets.select("name"), "name", "left_anti").select(*db.targets.columns)
        part = _written(_ranked_by(spark, new, post_mapping), f"{path}/targets")
        extra["targets"] = [*extra["targets"], part]
        new = spark.read.parquet(f"{path}/targets/{part}")
        store.append(index.build_index(_dealt(new), db.params), index_buckets(new, db.params), extra)
    else:
        store.annotate(extra)
    return Database.load(spark, path)


@dataclass
class QueryResult:
    """What a query of a database gives; each table is made when it is used."""

    classified: DataFrame
    candidates: DataFrame
    hits: DataFrame
    lines: DataFrame
    layout: str
    arrays: DataFrame
    truth: DataFrame | None = None
    rates: DataFrame | None = None
    coverage: DataFrame | None = None


def read_queries(spark: SparkSession, paths: list[str], pairing: str = "none", limit: int | None = None) -> DataFrame:
    """(query_id, header, seq1, seq2, file): ids count on over all files. pairing: none, files (two by two) or sequences."""
    files = sorted(f for p in paths for f in sequences.list_files(spark, p))
    groups = [files[i : i + 2] for i in range(0, len(files), 2)] if pairing == "files" else [[f] for f in files]
    out, before = None, 0
    for g in groups:
        s = [sequences.read_sequences(spark, f) for f in g]
        if len(s) == 2:
            r = naming.pair_files(*s)
        elif pairing == "sequences":
            r = naming.pair_consecutive(s[0])
        else:
            r = s[0].select(F.col("index").alias("query_id"), "header", F.col("data").alias("seq1"), F.lit("").alias("seq2"))
        if limit is not None:
            r = r.where(F.col("query_id") <= limit)
        r = r.withColumn("file", F.lit(g[0]))
        n = r.agg(F.max("query_id").alias("n")).first()["n"] or 0
        r = r.withColumn("query_id", F.col("query_id") + before)
        before += n
        out = r if out is None else out.unionByName(r)
    return out


def query(db: Database, reads: DataFrame, c: ClassifyParams = ClassifyParams(), fmt: report.Format = report.Format(), max_locations: int | None = None, remove_overpopulated: bool = False, exclude_rank: int | None = None, truth: DataFrame | None = None, query_params: SketchParams | None = None, precision: bool = False, taxon_coverage: bool = False) -> QueryResult:
    """Classifies reads. Query-time options shrink the index; exclude_rank hides the clade of the truth (query_id, truth_taxid).

    Truths are taken from headers where they are needed and not given: for fmt.truth, precision (which gives rates by rank),
    taxon_coverage (the confusion of what the database covers with what was classified) and exclude_rank.
    """
    p = query_params or db.params
    if (p.k, p.sketcher, p.hasher) != (db.params.k, db.params.sketcher, db.params.hasher):
        raise ValueError("reads must have the database's k-mers, sketcher and feature hash")
    c = c.resolved(p.size)
    read_features = stored(sketching.read_features(reads, p), "read-features")
    # caps hold for each feature alone, so features that no read has go before anything else
    features = db.lookup(read_features.select("feature").distinct())
    if remove_overpopulated:
        features = index.remove_overpopulated(features, min(max_locations or MAX_LOCATIONS, MAX_LOCATIONS))
    if max_locations is not None:
        features = index.cap_locations(features, max_locations)
    tax = db.all_taxa()
    lin = stored(taxonomy.lineages(tax), "lineages")
    arrays = stored(taxonomy.ranked_arrays(lin), "arrays")
    if truth is None and (fmt.truth or precision or taxon_coverage or exclude_rank is not None):
        truth = stored(evaluate.ground_truth(reads, tax, lin), "truth")
    hits = matching.probe(read_features, features)
    if exclude_rank is not None:
        hits = evaluate.exclude_clade(hits, truth, taxonomy.ancestor_at(lin, exclude_rank))
    hits = stored(hits, "hits")
    own = db.targets.select("tgt", "taxid")
    taxon_of = own.join(taxonomy.ancestor_at(lin, c.lowest), "taxid", "left").select("tgt", F.coalesce("anc", "taxid").alias("taxid"))
    best = matching.best_window_range(hits, matching.window_span(reads, db.params, c.insert_size))
    cand = stored(matching.top_taxa(best, taxon_of, c.max_candidates), "candidates")
    classified = stored(classify.with_all_reads(classify.classify(cand, arrays, c), reads), "classified")
    names = db.targets.select("tgt", "name")
    lists = {"top_hits": report.top_hits_text(cand, names, c.lowest), "all_hits": report.all_hits_text(hits, names), "locations": report.locations_text(cand, db.params)}
    lines = report.mapping_lines(classified, reads, tax, fmt, arrays, truth, **lists)
    rates = evaluate.rates(evaluate.statistics(classified, truth if precision else classified.select("query_id", F.lit(None).cast("long").alias("truth_taxid")), lin))
    coverage = evaluate.confusion_rates(evaluate.coverage_confusion(classified, truth, lin, taxonomy.covered(lin).select("taxid"))) if taxon_coverage else None
    return QueryResult(classified, cand, hits, lines, report.layout_line(fmt), arrays, truth, rates, coverage)


def alignments(db: Database, result: QueryResult, reads: DataFrame) -> DataFrame:
    """The best candidate's part of its target aligned with each read."""
    return align.align_candidates(result.candidates.where("pos = 1"), reads, db.targets, db.params)


def write_lines(result: QueryResult, path: str, c: ClassifyParams = ClassifyParams(), split_by: DataFrame | None = None, head: list[str] | None = None, tail: DataFrame | None = None) -> None:
    """Writes the lines of a query as text, with the lines that merge() looks for (head: instead of the first of them).

    split_by (query_id, file): a folder for each file, each with these lines. tail (line): written last, to the whole alone.
    """
    spark = result.lines.sparkSession
    first = head or [f"# Classification will be constrained to ranks from '{RANKS[c.lowest]}' to '{RANKS[c.highest]}'."]
    top = spark.createDataFrame([(x,) for x in [*first, result.layout]], "line string").coalesce(1)
    if split_by is None:
        top.write.mode("overwrite").text(path)
        result.lines.select("line").write.mode("append").text(path)
        if tail is not None:
            tail.select("line").coalesce(1).write.mode("append").text(path)
    else:
        files = split_by.select("query_id", headers.file_name(F.col("file")).alias("file"))
        each = files.select("file").distinct().join(F.broadcast(top)).select("line", "file")  # as many heads as files
        each.write.mode("overwrite").partitionBy("file").text(path)
        result.lines.join(files, "query_id").select("line", "file").write.mode("append").partitionBy("file").text(path)


def merge(spark: SparkSession, paths: list[str], tax: DataFrame, c: ClassifyParams = ClassifyParams()) -> DataFrame:
    """(query_id, taxid, rank): classifies anew from the top hits of several result files, in the order of their names."""
    lin = stored(taxonomy.lineages(tax), "lineages")
    rows = None
    for p in sorted(paths):
        r = taxa.read_results(spark, p)
        rows = r if rows is None else rows.unionByName(r)
    rows = stored(rows, "results")
    own = classify.merge_params(c).resolved()
    cand = classify.merge_candidates(rows, lin, c)
    done = classify.classify(cand, taxonomy.ranked_arrays(lin), own)
    return rows.select("query_id").distinct().join(done, "query_id", "left")


def info(db: Database, what: str = "config", rank: int = 4) -> DataFrame:
    """config, targets, lineages, rank, statistics, featurecounts or featuremap."""
    spark = db.taxa.sparkSession
    if what == "config":
        p = db.params
        return spark.createDataFrame([(p.k, p.size, p.window, p.stride, MAX_LOCATIONS)], "k int, size int, window int, stride int, max_locations int")
    if what == "featuremap":
        return db.features
    if what == "featurecounts":
        return index.feature_counts(db.features)
    if what == "statistics":
        ranked_targets = db.targets.agg(F.count("*").alias("targets"), F.count_if(F.col("parent") > 0).alias("ranked_targets"))
        own = index.index_statistics(db.features) if db.store is None else index.stored_statistics(spark, db.store.histogram())
        return own.join(ranked_targets).join(db.taxa.agg(F.count("*").alias("taxa")))
    lin = taxonomy.lineages(db.all_taxa())
    if what == "rank":
        return taxonomy.sequences_per_taxon(lin, rank)
    arrays = taxonomy.ranked_arrays(lin)
    named = db.targets.join(arrays, "taxid")
    columns = [F.coalesce(F.get("ranks", F.lit(i)), F.lit(0)).alias(RANKS[i]) for i in range(20)]
    if what == "lineages":
        return named.select("name", *columns)
    if what == "targets":
        windows = sketching.dna.window_count(F.length("dna"), db.params).alias("windows")
        return named.select("tgt", "name", "file", "index", windows, *columns)
    raise ValueError(f"no such information: {what}")


def annotate(lines: DataFrame, mapping: DataFrame, key: str = "accver", field_separator: str = " ", value_separator: str = "|") -> DataFrame:
    """lines (index, value) with taxids from mapping rows (file, row, acc, accver, gi, taxid) put into header lines.

    key: accver, acc or gi. Headers with an id that is not mapped get taxid 0, those without an id are left as they are.
    """
    get = {"accver": headers.accession_version, "acc": headers.accession, "gi": headers.gi_number}[key]
    first = naming.first_per_key(mapping.where(F.col(key).isNotNull()), key, ["file", "row"]).select(F.col(key).alias("id"), "taxid")
    d = lines.withColumn("id", F.when(F.col("value").rlike("^[>@]"), get(F.col("value")))).withColumn("id", F.when(F.col("id") != "", F.col("id")))
    d = d.join(first, "id", "left")
    new = headers.annotated(F.col("value"), F.when(F.col("id").isNotNull(), F.coalesce("taxid", F.lit(0))), field_separator, value_separator)
    return d.select("index", F.when(F.col("value").rlike("^[>@]"), new).otherwise(F.col("value")).alias("value"))


def abundance_of(result: QueryResult, db: Database, rank: int | None = None) -> DataFrame:
    """(taxid, n, percent) of a query; with rank, counts brought to that rank."""
    a = classify.abundances(result.classified)
    if rank is None:
        return a
    e = classify.estimate_abundances(a, taxonomy.lineages(db.all_taxa()), rank)
    return e.join(F.broadcast(result.classified.agg(F.count("*").alias("total")))).select("taxid", "n", (100 * F.col("n") / F.col("total")).alias("percent"))
