"""Named queries over the test tables: one for each operator or group of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna, hashes, headers
from ..operators import align, classify, evaluate, index, intervals, matching, naming, report, sketching, taxonomy
from ..operators import moments as states
from ..operators.layers import LayeredIndex, Policy, bucket_number
from ..params import RANKS, ClassifyParams
from ..storage import shared_dir, stored
from . import file_queries
from . import fixtures as fx

C = ClassifyParams().resolved()
C4 = ClassifyParams(hits_min=4, hits_diff=80, max_candidates=4, lowest=fx.SPECIES).resolved()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _place(s, label):
    return f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"


#: Bytes of documents whose features are sorted in one task, which takes about 14 times as much.
SORTED_BYTES = 8 << 20


def _index(s, d, p=fx.CLASSIFY):
    return index.build_index(fx.targets(s, d, SORTED_BYTES), p)


def _capped(s, d):
    return index.cap_locations(_index(s, d))


def _hits(s, d, reads=None):
    """Caps hold for each feature alone, so features that no read has are dropped before they are sorted for them."""
    features = stored(sketching.read_features(fx.reads(s, d) if reads is None else reads, fx.CLASSIFY), "read-features")
    found = _index(s, d).join(features.select("feature").distinct(), "feature", "left_semi")
    return matching.probe(features, index.cap_locations(found))


def _best(s, d):
    return matching.best_window_range(_hits(s, d), matching.window_span(fx.reads(s, d), fx.CLASSIFY))


def _lineages(s, d):
    """Stored, since a recursive query is made anew in each branch of a plan that reads it."""
    return stored(taxonomy.lineages(fx.taxa(s, d)), "lineages")


def _taxon_of(s, d, rank, lin=None):
    """(tgt, taxid) at a rank."""
    t = fx.targets(s, d).select("tgt", "taxid")
    if rank == 0:
        return t
    up = taxonomy.ancestor_at(taxonomy.lineages(fx.taxa(s, d)) if lin is None else lin, rank)
    return t.join(up, "taxid", "left").select("tgt", F.coalesce("anc", "taxid").alias("taxid"))


def _candidates(s, d, c, lin):
    return stored(matching.top_taxa(_best(s, d), _taxon_of(s, d, c.lowest, lin), c.max_candidates), "candidates")


def _classified(s, d, c=C, lin=None, cand=None):
    lin = _lineages(s, d) if lin is None else lin
    cand = _candidates(s, d, c, lin) if cand is None else cand
    return classify.with_all_reads(classify.classify(cand, taxonomy.ranked_arrays(lin), c), fx.reads(s, d))


@query
def seq_windows(s, d):
    w = sketching.sequence_windows(fx.targets(s, d), "tgt", "dna", fx.CLASSIFY)
    return w.groupBy("tgt").agg(F.count("*").alias("n_windows"), F.sum(F.length("s")).alias("letters"), F.max("win").alias("last_win"), F.max_by("s", "win").alias("last_window"))


@query
def kmer_canonical(s, d):
    """Letters become N here where they are no bases, so that k-mers with other letters occur."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = F.regexp_replace(F.translate(F.lower("text"), letters, "".join("ACGT"[i % 4] for i in range(26))), "[^ACGT]", "N")
    k = fx.table(s, d, "benchmark").select("item_id", F.explode(F.filter(dna.kmers(text, 8), dna.unambiguous)).alias("kmer"))
    k = k.select("item_id", "kmer", dna.canonical(F.col("kmer")).alias("canon"), dna.reverse_complement(F.col("kmer")).alias("rc"))
    return k.groupBy("item_id", "canon").agg(F.count("*").alias("n"), F.min("kmer").alias("lowest"), F.max("rc").alias("highest_rc"))


@query
def kmer_hash(s, d):
    k = fx.reads(s, d).select("query_id", F.explode(F.array_distinct(F.transform(dna.kmers(F.col("seq1"), 10), dna.canonical))).alias("kmer"))
    c = dna.code(F.col("kmer"))
    return k.select("query_id", "kmer", c.alias("code"), dna.hash32(c).alias("hash"), dna.hash_murmur32(c).alias("murmur"))


@query
def integer_hashes(s, d):
    """The other hashes of numbers made of orders."""
    o = fx.table(s, d, "orders")
    x = F.col("o_orderkey") * 1_000_003_000_007 + F.col("o_custkey")
    low = x.bitwiseAND(F.lit(2**32 - 1).cast("long"))
    return o.select("o_orderkey", hashes.murmur64(x).alias("murmur64"), hashes.splitmix64(x).alias("splitmix64"), hashes.halved(x).alias("halved"), hashes.six_rounds32(low).alias("six_rounds"))


@query
def sketch_features(s, d):
    return sketching.sketch_features(fx.targets(s, d), "tgt", "dna", fx.CLASSIFY)


@query
def wide_sketch_features(s, d):
    """k-mers of 21 letters, with hashes of 64 bits."""
    return sketching.sketch_features(fx.targets(s, d), "tgt", "dna", fx.WIDE)


@query
def syncmer_features(s, d):
    """Closed syncmers alone."""
    return sketching.sketch_features(fx.targets(s, d), "tgt", "dna", fx.SYNCMERS)


@query
def kmer_letter_stats(s, d):
    c = dna.letter_counts(F.col("dna"))
    return fx.targets(s, d).select("tgt", F.length("dna").cast("long").alias("n"), *(c[x].alias(f"n_{x}") for x in "acgt"), F.greatest(F.length("dna") - 9, F.lit(0)).cast("long").alias("n_kmers"))


@query
def kmer_pair_stats(s, d):
    """Pairs of bases side by side in each target; one row for each pair."""
    t = fx.targets(s, d).select("tgt", F.explode(dna.pair_counts(F.col("dna"))).alias("pair", "n"))
    return t.select("tgt", "pair", F.col("n").cast("long").alias("n"))


@query
def kmer_intersection(s, d):
    r = fx.reads(s, d).select(F.col("query_id").alias("id"), F.col("seq1").alias("seq"))
    x = sketching.kmer_intersection(r, r, "id", "seq", 8)
    return x.where("key_a <> key_b")


@query
def index_counts(s, d):
    return index.feature_counts(_index(s, d))


@query
def index_stats(s, d):
    m = index.index_statistics(_index(s, d))
    return m.select("n", "total", "largest", *(F.round(c, 6).alias(c) for c in ("mean", "stddev", "skewness")))


@query
def moments(s, d):
    m = index.moments(fx.table(s, d, "lineitem"), "l_quantity")
    return m.select("n", F.col("total").cast("double").alias("total"), F.col("largest").cast("double").alias("largest"), *(F.round(c, 6).alias(c) for c in ("mean", "stddev", "skewness", "kurtosis")))


@query
def moments_removed(s, d):
    """Quantities without those of every fifth supplier, from states that are kept for each supplier: all are merged, and
    these are merged and taken back."""
    own = stored(states.state(fx.table(s, d, "lineitem"), "l_quantity", ["l_suppkey"]), "states")
    rest = states.removed(states.merged(own), states.merged(own.where("l_suppkey % 5 = 0")))
    x = states.described(rest)
    return x.select("n", *(F.round(c, 5).alias(c) for c in x.columns if c != "n"))


@query
def moments_by_flag(s, d):
    """States of suppliers and flags, merged by flag."""
    own = stored(states.state(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_suppkey"]), "states")
    x = states.described(states.merged(own, ["l_returnflag"]), ["l_returnflag"])
    return x.select("l_returnflag", "n", *(F.round(c, 5).alias(c) for c in ("mean", "stddev", "skewness", "kurtosis", "excess")))


@query
def layered_statistics(s, d):
    """Statistics of an index that grew by layers, from numbers that are stored with it and changed by what came in."""
    m = index.stored_statistics(s, _in_layers(s, d, fx.CROWDED, Policy(remove_overpopulated=True)).histogram())
    return m.select("n", "total", "largest", *(F.round(c, 6).alias(c) for c in ("mean", "stddev", "skewness", "kurtosis")))


@query
def index_capped(s, d):
    return index.cap_locations(_index(s, d, fx.CROWDED), 100)


@query
def overpopulated_removed(s, d):
    return index.remove_overpopulated(_index(s, d, fx.CROWDED))


@query
def ambiguous_removed(s, d):
    anc = _taxon_of(s, d, fx.DOMAIN).select("tgt", F.col("taxid").alias("anc"))
    return index.remove_ambiguous(_index(s, d), anc, 1)


@query
def dedup_targets(s, d):
    """Sources stand for names: of each the first document with letters stays."""
    t = fx.targets(s, d).withColumn("name", F.concat_ws("/", "lang", "source"))
    return index.unique_targets(t, ["tgt"]).select("tgt", "name")


@query
def feature_probe(s, d):
    return sketching.read_features(fx.reads(s, d), fx.CLASSIFY).join(_capped(s, d), "feature").select("query_id", "feature", "tgt", "win", F.col("n"))


@query
def hits_per_window(s, d):
    return _hits(s, d)


@query
def best_window_range(s, d):
    return _best(s, d)


@query
def all_window_ranges(s, d):
    return matching.all_window_ranges(_hits(s, d), matching.window_span(fx.reads(s, d), fx.CLASSIFY))


@query
def topk_candidates(s, d):
    return matching.top_candidates(_best(s, d), 4)


@query
def topk_by_ancestor(s, d):
    return matching.top_taxa(_best(s, d), _taxon_of(s, d, fx.SPECIES), 4)


@query
def classify_best_target(s, d):
    best = matching.top_candidates(_best(s, d), 1).where(F.col("hits") >= C.hits_min)
    return best.select("query_id", "tgt", "hits", "beg", "end")


@query
def classify_lca(s, d):
    return _classified(s, d)


@query
def classify_species(s, d):
    return _classified(s, d, C4)


@query
def hits_per_target(s, d):
    return matching.hits_per_target(_hits(s, d))


@query
def paired_reads(s, d):
    r = fx.paired_reads(s, d)
    span = matching.window_span(r, fx.CLASSIFY, 500)
    best = matching.best_window_range(_hits(s, d, r), span).join(span, "query_id")
    return matching.top_candidates(best, 2).select("query_id", "pos", "tgt", "hits", "beg", "end", "span")


@query
def merge_results(s, d):
    """Two result files: reads against documents of even and of odd ids; merged and classified again."""
    lin = _lineages(s, d)
    one = matching.top_taxa(_best(s, d), _taxon_of(s, d, fx.SPECIES, lin), 6).withColumn("file", (F.col("tgt") % 2).cast("string"))
    c = ClassifyParams(max_candidates=3)
    cand = classify.merge_candidates(one.select("file", "pos", "query_id", "taxid", "hits"), lin, c)
    out = classify.classify(cand, taxonomy.ranked_arrays(lin), classify.merge_params(c).resolved())
    n = cand.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.max("hits").alias("most"))
    return out.join(n, "query_id").select("query_id", "taxid", "rank", "n_candidates", "most")


@query
def tax_lineage_full(s, d):
    return taxonomy.lineages(fx.geography(s, d))


@query
def tax_lineage_ranked(s, d):
    return taxonomy.ranked(taxonomy.lineages(fx.geography(s, d)))


@query
def tax_next_ranked(s, d):
    g = fx.geography(s, d)
    return taxonomy.next_ranked(taxonomy.lineages(g), g)


def _traded(s, d):
    """(a, b): each customer with each supplier of any of the customer's orders."""
    o, i = fx.table(s, d, "orders"), fx.table(s, d, "lineitem")
    pairs = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return pairs.select((F.col("o_custkey") + 2_000_000).alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b"))


@query
def tax_lca_full(s, d):
    return taxonomy.lca_full(_traded(s, d), taxonomy.lineages(fx.geography(s, d)))


@query
def tax_lca_ranked(s, d):
    return taxonomy.lca_ranked(_traded(s, d), taxonomy.lineages(fx.geography(s, d)))


@query
def classify_odd_candidates(s, d):
    """Orders stand for reads, customers and suppliers for their candidates: some have no rank, some are not known at all, many
    are the only one, and ties and thresholds occur."""
    o, i = fx.table(s, d, "orders"), fx.table(s, d, "lineitem")
    key = F.col("o_orderkey")
    first = o.select(key.alias("query_id"), F.when(key % 11 == 0, key + 50_000_000).otherwise(F.col("o_custkey") + 2_000_000).alias("taxid"), F.when(key % 13 == 0, 3).otherwise(10).cast("long").alias("hits"))
    more = i.where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") + 1_000_000).alias("taxid")).agg(F.max(F.col("l_quantity") % 11).cast("long").alias("hits"))
    cand = first.unionByName(more)
    cand = cand.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("taxid"))))
    c = ClassifyParams(hits_min=4, hits_diff=0.8, lowest=fx.SPECIES, highest=fx.DOMAIN).resolved()
    return classify.classify(cand, taxonomy.ranked_arrays(taxonomy.lineages(fx.geography(s, d))), c)


@query
def rank_distribution(s, d):
    return taxonomy.sequences_per_taxon(taxonomy.lineages(fx.taxa(s, d)), fx.SPECIES)


@query
def taxon_coverage(s, d):
    return taxonomy.covered(taxonomy.lineages(fx.taxa(s, d)))


@query
def abundance(s, d):
    a = classify.abundances(stored(_classified(s, d, C4), "classified"))
    return a.select("taxid", "n", F.round("percent", 6).alias("percent"))


@query
def abundance_estimate(s, d):
    """Orders stand for reads: nations count those of their customers, a third of them known by region or nation alone."""
    o = fx.table(s, d, "orders").join(fx.table(s, d, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(fx.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey") % 6
    taxid = F.when(k == 0, F.col("n_regionkey") + 10).when(k == 1, F.col("n_nationkey") + 100).otherwise(F.col("c_custkey") + 2_000_000)
    counts = o.select(taxid.cast("long").alias("taxid")).groupBy("taxid").agg(F.count("*").alias("n"))
    e = classify.estimate_abundances(counts, taxonomy.lineages(fx.geography(s, d)), fx.SPECIES)
    return e.select("taxid", F.round("n", 6).alias("n"))


@query
def clade_exclusion(s, d):
    anc = taxonomy.ancestor_at(taxonomy.lineages(fx.taxa(s, d)), fx.DOMAIN)
    return evaluate.exclude_clade(_hits(s, d), fx.truth(s, d), anc)


def _headers(s, d):
    """Headers of several kinds made of document numbers."""
    i = F.col("doc_id").cast("string")
    kinds = [F.concat(F.lit("NC_"), F.lpad(i, 6, "0"), F.lit(".2 some words")), F.concat(F.lit("gi|"), i, F.lit("|ref|NZ_AB"), i, F.lit(".1| name")), F.concat(F.lit("GCF_"), i, F.lit("-x_y.3")), F.concat(F.lit("contig"), i, F.lit(" taxid|"), i, F.lit(" end")), F.concat(F.lit("gi|"), i, F.lit(" no number")), F.concat(F.lit("plain"), i), F.concat(F.lit("AE"), i, F.lit(" taxid:12x|z")), F.lit("")]
    pick = F.col("doc_id") % len(kinds)
    out = F.lit(None).cast("string")
    for j, k in enumerate(kinds):
        out = F.when(pick == j, k).otherwise(out)
    return fx.table(s, d, "documents").select("doc_id", out.alias("header"))


@query
def extract_accession(s, d):
    h = F.col("header")
    return _headers(s, d).select("doc_id", headers.accession_version(h).alias("accver"), headers.accession(h).alias("acc"), headers.gi_number(h).alias("gi"), headers.sequence_id(h).alias("seq_id"))


@query
def extract_taxid(s, d):
    return _headers(s, d).select("doc_id", headers.taxon_id(F.col("header")).alias("taxid"), headers.first_word(F.col("header")).alias("word"))


@query
def annotate_headers(s, d):
    """Every second accession has a taxid; headers without an accession get none."""
    h = _headers(s, d).withColumn("acc", headers.accession_version(F.col("header")))
    m = h.where("acc <> '' and doc_id % 2 = 0").groupBy("acc").agg(F.min("doc_id").alias("t"))
    d2 = h.join(m, "acc", "left").withColumn("t", F.when(F.col("acc") != "", F.coalesce("t", F.lit(0))))
    return d2.select("doc_id", headers.annotated(F.col("header"), F.col("t")).alias("line"))


@query
def similar_name_lookup(s, d):
    """Names of parts cut short are looked up among whole ones."""
    p = fx.table(s, d, "part").select("p_name").distinct()
    wanted = p.select(F.expr("substring(p_name, 1, greatest(length(p_name) - 4, 1))").alias("acc")).distinct()
    return naming.similar_names(wanted, p.select(F.col("p_name").alias("name")))


@query
def parent_resolution(s, d):
    i = F.col("s_suppkey")
    m = fx.table(s, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("acc"), F.col("c_custkey").cast("string"), F.lit(".1")).alias("key"), F.col("c_nationkey").cast("long").alias("taxid"))
    t = fx.table(s, d, "supplier").select(i.alias("tgt"), F.concat(F.lit("acc"), i.cast("string"), F.when(i % 2 == 0, ".1").otherwise("")).alias("seq_id"), F.concat(F.lit("acc"), (i + 1).cast("string"), F.lit(".1")).alias("file_id"), (i % 4 - 1).alias("header_taxid"))
    return naming.resolve_parents(t, m)


@query
def post_rank_mapping(s, d):
    """Order lines stand for the rows of two mapping files."""
    i = F.col("p_partkey")
    t = fx.table(s, d, "part").select(i.alias("tgt"), F.when(i % 3 == 0, F.concat(F.lit("p"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("p"), i.cast("string"), F.lit(".1"))).otherwise(i.cast("string")).alias("name"), F.when(i % 10 == 0, i).otherwise(0).cast("long").alias("parent"))
    k = F.col("l_partkey").cast("string")
    rows = fx.table(s, d, "lineitem").select((F.col("l_orderkey") % 2).alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.concat(F.lit("p"), k, F.lit(".")).alias("acc"), F.concat(F.lit("p"), k).alias("accver"), k.alias("gi"), F.col("l_suppkey").alias("taxid"))
    return naming.rank_unranked(t, rows)


@query
def ground_truth(s, d):
    """Headers that name a document by accession and version, by accession alone, a taxon by its id or its name, or nothing."""
    i = F.col("item_id")
    acc = F.concat(F.lit("NC_"), F.lpad(i.cast("string"), 6, "0"))
    kinds = [F.concat(acc, F.lit(".1 whole")), F.concat(acc, F.lit(".7 other version")), F.concat(F.lit("contig taxid|"), F.lit(108000).cast("string"), F.lit(" end")), F.lit("fr"), F.lit("nothing known"), F.concat(F.lit("gi|5|ref|"), acc, F.lit(".1| named"))]
    header = F.element_at(F.array(*kinds), (i % 6 + 1).cast("int"))
    t = fx.taxa(s, d).withColumn("name", F.when(F.col("taxid") < 0, F.concat(F.lit("NC_"), F.lpad((-F.col("taxid") - 1).cast("string"), 6, "0"), F.lit(".1"))).otherwise(F.col("name")))
    return evaluate.ground_truth(fx.table(s, d, "benchmark").select((i + 1).alias("query_id"), header.alias("header")), t, taxonomy.lineages(t))


@query
def classification_stats(s, d):
    lin = _lineages(s, d)
    st = evaluate.statistics(stored(_classified(s, d, C, lin), "classified"), fx.truth(s, d), lin)
    return evaluate.rates(st).select("rank", "assigned", "known", "correct", "wrong", *(F.round(c, 6).alias(c) for c in ("classified_rate", "known_rate", "precision", "sensitivity")))


@query
def coverage_confusion(s, d):
    """The database is said to cover taxa that more than 20 documents belong to, or even documents."""
    lin = _lineages(s, d)
    cov = taxonomy.covered(lin).where("n > 20 or taxid % 2 = 0").select("taxid")
    x = evaluate.confusion_rates(evaluate.coverage_confusion(_classified(s, d, C, lin), fx.truth(s, d), lin, cov))
    return x.select("rank", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "specificity", "precision", "negative_value", "false_omission", "fall_out", "false_discovery", "miss_rate")))


@query
def mapping_report(s, d):
    lin = _lineages(s, d)
    cand = _candidates(s, d, C4, lin)
    f = report.Format(query_ids=True, top_hits=True, taxon="rank_name_id")
    return report.mapping_lines(_classified(s, d, C4, lin, cand), fx.reads(s, d), fx.taxa(s, d), f, top_hits=report.top_hits_text(cand))


@query
def all_hits_report(s, d):
    return report.all_hits_text(_hits(s, d), fx.targets(s, d).select("tgt", "name"))


@query
def locations_report(s, d):
    cand = matching.top_taxa(_best(s, d), _taxon_of(s, d, fx.SPECIES), 4)
    return report.locations_text(cand, fx.CLASSIFY)


@query
def abundance_report(s, d):
    return report.abundance_lines(classify.abundances(stored(_classified(s, d, C4), "classified")), fx.taxa(s, d))


@query
def info_targets(s, d):
    """Windows and letters of each target with its species and domain."""
    a = taxonomy.ranked_arrays(taxonomy.lineages(fx.taxa(s, d)))
    t = fx.targets(s, d).join(a, "taxid")
    return t.select("tgt", "name", dna.window_count(F.length("dna"), fx.CLASSIFY).cast("long").alias("windows"), F.get("ranks", F.lit(fx.SPECIES)).alias("species"), F.get("ranks", F.lit(fx.DOMAIN)).alias("domain"))


@query
def info_lineages(s, d):
    """A row for each target: the taxids of all ranks, 0 where there is none."""
    a = taxonomy.ranked_arrays(taxonomy.lineages(fx.taxa(s, d))).where("taxid < 0")
    return a.select("taxid", *(F.coalesce(F.get("ranks", F.lit(i)), F.lit(0)).alias(RANKS[i]) for i in range(20)))


@query
def semi_global_align(s, d):
    """The best target's part beside each read."""
    best = matching.top_candidates(_best(s, d), 1)
    return align.align_candidates(best, fx.reads(s, d), fx.targets(s, d), fx.CLASSIFY)


@query
def align_scores(s, d):
    """The scores of these alignments alone."""
    best = matching.top_candidates(_best(s, d), 1)
    return align.align_candidates(best, fx.reads(s, d), fx.targets(s, d), fx.CLASSIFY).select("query_id", "tgt", "score")


@query
def stream_classify(s, d):
    """Micro-batches of reads against an index that is stored once."""
    from ..streaming.classification import classify_stream_once

    store = LayeredIndex.create(s, _place(s, "stream-index"), _index(s, d))
    arrays = stored(taxonomy.ranked_arrays(_lineages(s, d)), "arrays")
    return classify_stream_once(s, fx.reads(s, d), store, _taxon_of(s, d, C.lowest), arrays, fx.CLASSIFY, C)


@query
def stream_abundance(s, d):
    """Running counts of classified reads that come in three parts; the query is stopped and started again before the last
    one, and some reads come twice, the second time without a taxon."""
    from ..streaming import abundance

    base = _place(s, "counts")
    done = stored(_classified(s, d, C4), "classified")
    for i in range(3):
        part = done.where(F.pmod("query_id", F.lit(3)) == i)
        again = done.where(F.pmod("query_id", F.lit(3)) == i - 1).withColumn("taxid", F.lit(None).cast("long"))
        part.unionByName(again).write.mode("append").parquet(f"{base}/in")
        stream = s.readStream.schema(abundance.CLASSIFIED).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        abundance.abundance_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return abundance.latest_counts(s, f"{base}/out").select("taxid", "n", F.round("percent", 6).alias("percent"))


@query
def tax_intervals(s, d):
    """Numbers of a tour through regions, nations, customers and suppliers."""
    return intervals.tour(intervals.inner(fx.geography(s, d))).select("taxid", "depth", "enter", "leave")


@query
def tax_lca_intervals(s, d):
    """The pairs of tax_lca_full by interval labels."""
    g = stored(fx.geography(s, d), "taxa")
    labels = intervals.tour(intervals.inner(g))
    return intervals.lowest_common(_traded(s, d), g, labels, intervals.highest_table(labels))


@query
def taxon_coverage_intervals(s, d):
    return intervals.coverage(stored(fx.taxa(s, d), "taxa"))


def _in_layers(s, d, p, policy):
    """The index of all targets, in three layers: those whose number divides by three first, then the others."""
    part = lambda i: index.build_index(fx.targets(s, d, of=f"pmod(doc_id, 3) = {i}"), p)
    # layers differ in their buckets, as those do that come in over time; each grows with what there is to index
    letters = fx.table(s, d, "documents").agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    own = bucket_number(letters // 3, p)
    store = LayeredIndex.create(s, _place(s, "layers"), part(0), policy, own + 3)
    return store.append(part(1), own + 1).append(part(2), own + 2)


@query
def layered_removed(s, d):
    """What is left of an index that grew by layers, its overpopulated features removed with each."""
    return _in_layers(s, d, fx.CROWDED, Policy(remove_overpopulated=True)).rows(tombstones=False)


@query
def layered_compacted(s, d):
    """The first hundred locations of each feature over all layers, after these were merged."""
    return _in_layers(s, d, fx.CROWDED, Policy(100)).compact(everything=True).rows(tombstones=False)


@query
def layered_lookup(s, d):
    """Matches of all reads with an index in layers."""
    features = stored(sketching.read_features(fx.reads(s, d), fx.CLASSIFY), "read-features")
    store = _in_layers(s, d, fx.CLASSIFY, Policy())
    return matching.probe(features, store.lookup(features.select("feature").distinct()))


QUERIES |= file_queries.QUERIES
