"""Comparing classifications with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers
from ..params import NONE, RANKS, ROOT
from . import naming, taxonomy


def exclude_clade(hits: DataFrame, truth: DataFrame, ancestors: DataFrame) -> DataFrame:
    """hits (query_id, tgt, ...) without targets whose ancestor at the excluded rank is that of the read's truth.

    truth is (query_id, truth_taxid), ancestors (taxid, anc) at the rank; where the truth has no ancestor nothing goes.
    """
    own = ancestors.select(F.col("taxid").alias("truth_taxid"), F.col("anc").alias("truth_anc"))
    t = truth.where("truth_taxid is not null").join(own, "truth_taxid").select("query_id", "truth_anc")
    a = ancestors.select((-F.col("taxid") - 1).alias("tgt"), "anc")
    d = hits.join(t, "query_id", "left").join(a, "tgt", "left")
    keep = F.col("truth_anc").isNull() | ~F.col("anc").eqNullSafe(F.col("truth_anc"))
    return d.where(keep).select(*hits.columns)


def ground_truth(reads: DataFrame, taxa: DataFrame, lin: DataFrame) -> DataFrame:
    """(query_id, truth_taxid) of (query_id, header): the taxon named by the header's accession and version, else the one whose
    name continues its accession, else the one with the taxid in it, else the one named by all of it; of that the next ranked
    ancestor. Null where there is none."""
    h = F.col("header")
    d = reads.select("query_id", "header", headers.accession_version(h).alias("accver"), headers.accession(h).alias("acc"), headers.taxon_id(h).alias("taxid"))
    by_name = taxa.groupBy("name").agg(F.min("taxid").alias("t"))
    near = naming.similar_names(d.select("acc"), taxa.select("name"))
    d = d.join(by_name.select(F.col("name").alias("accver"), F.col("t").alias("t1")), "accver", "left")
    d = d.join(near, "acc", "left").join(by_name.select(F.col("name").alias("similar"), F.col("t").alias("t2")), "similar", "left")
    d = d.join(taxa.select("taxid", F.col("taxid").alias("t3")), "taxid", "left")
    d = d.join(by_name.select(F.col("name").alias("header"), F.col("t").alias("t4")), "header", "left")
    d = d.select("query_id", F.coalesce("t1", "t2", "t3", "t4").alias("taxid"))
    return d.join(taxonomy.next_ranked(lin, taxa), "taxid", "left").select("query_id", F.col("anc").alias("truth_taxid"))


def statistics(classified: DataFrame, truth: DataFrame, lin: DataFrame) -> DataFrame:
    """(rank, assigned, known, correct, wrong) for all ranks and none.

    classified (query_id, taxid, rank), truth (query_id, truth_taxid). What holds at a rank holds at all above it; a read
    is wrong below its lowest correct rank if that is above both its own and the known rank.
    """
    rank_of = lin.where("depth = 0").select(F.col("taxid").alias("truth_taxid"), F.col("rank").alias("known"))
    d = classified.join(truth, "query_id", "left").join(rank_of, "truth_taxid", "left")
    pairs = d.where("taxid is not null and truth_taxid is not null").select(F.col("taxid").alias("a"), F.col("truth_taxid").alias("b")).distinct()
    lca = taxonomy.lca_ranked(pairs, lin).select(F.col("a").alias("taxid"), F.col("b").alias("truth_taxid"), F.col("rank").alias("lca_rank"))
    d = d.join(lca, ["taxid", "truth_taxid"], "left")
    none = F.lit(NONE)
    d = d.select(F.coalesce("rank", none).alias("a"), F.coalesce("known", none).alias("k"), F.coalesce("lca_rank", none).alias("c"))
    d = d.withColumn("c", F.greatest("c", "a", "k"))
    # reads are first counted by their three ranks, so that few rows meet the list of ranks
    d = d.groupBy("a", "k", "c").agg(F.count("*").alias("n"))
    ranks = F.explode(F.sequence(F.lit(0), F.lit(NONE))).alias("rank")
    d = d.select("*", ranks)

    def holds(lowest: str) -> Column:
        low = F.col(lowest)
        return F.when(low == NONE, F.col("rank") == NONE).otherwise((F.col("rank") >= low) & (F.col("rank") <= ROOT))

    known = F.col("k") != NONE
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    wrong = known & (F.col("c") > F.col("k")) & (F.col("c") > F.col("a")) & (F.col("rank") < F.col("c"))
    return d.groupBy("rank").agg(total(holds("a")).alias("assigned"), total(holds("k")).alias("known"), total(known & holds("c")).alias("correct"), total(wrong).alias("wrong"))


def rates(stats: DataFrame) -> DataFrame:
    """stats with classified, known and unclassified shares of all reads, precision and sensitivity; null where undefined."""
    total = F.sum(F.when(F.col("rank") >= ROOT, F.col("assigned")))
    d = stats.join(F.broadcast(stats.agg(total.alias("total"))))
    share = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return d.select("rank", "assigned", "known", "correct", "wrong", share(c("assigned"), c("total")).alias("classified_rate"), share(c("known"), c("total")).alias("known_rate"), share(c("correct"), c("correct") + c("wrong")).alias("precision"), share(c("correct"), c("known")).alias("sensitivity"))


def coverage_confusion(classified: DataFrame, truth: DataFrame, lin: DataFrame, covered: DataFrame) -> DataFrame:
    """(rank, tp, fp, tn, fn): for each ranked ancestor of each read's truth, whether the database covers it (covered: taxid)
    and whether the read is classified at its rank."""
    lineage = taxonomy.ranked(lin).select(F.col("taxid").alias("truth_taxid"), F.col("rank").alias("r"), "anc")
    d = classified.join(truth, "query_id").join(lineage, "truth_taxid").join(covered.select(F.col("taxid").alias("anc"), F.lit(True).alias("cov")), "anc", "left")
    on = F.col("rank").isNotNull() & (F.col("r") >= F.col("rank"))
    cov = F.col("cov").isNotNull()
    n = lambda cond: F.count_if(cond)
    return d.groupBy(F.col("r").alias("rank")).agg(n(cov & on).alias("tp"), n(~cov & on).alias("fp"), n(~cov & ~on).alias("tn"), n(cov & ~on).alias("fn"))


def confusion_rates(confusion: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity, precision and their complements; null where undefined."""
    c = F.col
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, tn, fn = (c(x) for x in ("tp", "fp", "tn", "fn"))
    return confusion.select("rank", "tp", "fp", "tn", "fn", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), share(tp, tp + fp).alias("precision"), share(tn, tn + fn).alias("negative_value"), share(fn, tn + fn).alias("false_omission"), share(fp, tn + fp).alias("fall_out"), share(fp, tp + fp).alias("false_discovery"), share(fn, tp + fn).alias("miss_rate"))


def rank_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANKS)), rank + 1)
