"""Classification of reads, abundances, and merging of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import NONE, ClassifyParams, merge_params
from ..storage import stored
from . import taxonomy


def classify(candidates: DataFrame, rank_arrays: DataFrame, c: ClassifyParams) -> DataFrame:
    """(query_id, taxid, rank) of (query_id, pos, taxid, hits), for reads with candidates; null taxid: unclassified.

    Reads whose best candidate has fewer than hits_min hits are unclassified. Otherwise all others with more hits than the
    threshold, (hits - hits_min) * hits_diff of the best, are used besides it. A best candidate that is alone is the result
    itself, whatever it is; of several it is their lowest common ranked ancestor. Above the highest rank, without a rank and
    with a taxon that the taxonomy does not know (rank_arrays, see taxonomy.ranked_arrays, has a row for each) a read is
    unclassified. In a tree, taxa that share an ancestor share all above it, so the common part of rank arrays is its array.
    """
    w = Window.partitionBy("query_id")
    top = F.max("hits").over(w)
    threshold = F.when(top > c.hits_min, (top - c.hits_min) * F.lit(c.hits_diff)).otherwise(0.0)
    d = candidates.withColumn("top", top).withColumn("threshold", threshold)
    used = d.where((F.col("top") >= c.hits_min) & ((F.col("pos") == 1) | (F.col("hits") > F.col("threshold"))))
    used = used.join(rank_arrays, "taxid", "left")
    lists = used.groupBy("query_id").agg(F.collect_list("ranks").alias("all"), F.count("*").alias("n"), F.count("own").alias("known"), F.min_by("taxid", "pos").alias("best"), F.min_by("own", "pos").alias("own"))
    same = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: F.when(p == q, p)))
    at = F.array_position(F.transform(same, lambda x: x.isNotNull()), F.lit(True)) - 1
    lca = lists.select("*", same.alias("same"), F.when((F.col("n") > 1) & (at >= 0), at).otherwise(F.when(F.col("n") == 1, F.col("own"))).cast("int").alias("at"))
    ok = (F.col("known") == F.col("n")) & (F.col("at") <= c.highest)
    found = lca.select("query_id", F.when(ok, F.when(F.col("n") == 1, F.col("best")).otherwise(F.get("same", F.col("at")))).alias("taxid"), F.when(ok, F.col("at")).alias("rank"))
    return candidates.select("query_id").distinct().join(found, "query_id", "left")


def with_all_reads(classified: DataFrame, reads: DataFrame) -> DataFrame:
    """One row for each read, also for those without any candidate."""
    return reads.select("query_id").join(classified, "query_id", "left")


def abundances(classified: DataFrame) -> DataFrame:
    """(taxid, n, percent): reads of each taxon, null for unclassified ones; percent of all reads."""
    n = classified.groupBy("taxid").agg(F.count("*").alias("n"))
    total = classified.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("taxid", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def _with_lineages(counts: DataFrame, lin: DataFrame, how: str) -> DataFrame:
    """(taxid, n, own, ups) of (taxid, n): its rank, and structs (rank, neg, anc) of the farthest taxon of its lineage at each rank, by rank."""
    at = F.struct("rank", (-F.col("depth")).alias("neg"), "anc")
    d = counts.join(lin.hint("merge"), "taxid", how).groupBy("taxid").agg(F.first("n").alias("n"), F.max(F.when(F.col("depth") == 0, F.col("rank"))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("rank") < NONE, at))).alias("all"))
    return d.select("taxid", "n", "own", F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["rank"] < x["rank"])).alias("ups"))


def estimate_abundances(counts: DataFrame, lin: DataFrame, rank: int) -> DataFrame:
    """(taxid, n double): counts of (taxid, n) brought to a rank.

    Counts below the rank move up to the nearest ancestor at the rank or above. Every counted taxon is then tied to the
    nearest counted one above it; from the root on, each that has such children gives them its count in proportion to
    theirs and all below, and leaves the table. Every taxon's final factor is the product over its chain, so one pass over
    lineages does it: a leaf with weight t(x) (own and all below) gets own + sum over its counted ancestors p of
    n(p) * product of shares down to it, which equals multiplying along the chain from the top. Counts meet lineages by shuffles;
    only counted taxa that have others below them are looked up.
    """
    counts = counts.where("taxid is not null").groupBy("taxid").agg(F.sum("n").cast("double").alias("n"))
    if rank > 0:
        up = F.get(F.filter("ups", lambda x: x["rank"] >= rank), F.lit(0))["anc"]
        moved = F.when((F.col("own") < rank) & up.isNotNull(), up).otherwise(F.col("taxid"))
        counts = _with_lineages(counts, lin, "inner").select(moved.alias("taxid"), "n").groupBy("taxid").agg(F.sum("n").alias("n"))
    # counted taxa with all ancestors of higher ranks, then those ancestors that are counted themselves
    above = F.transform(F.filter("ups", lambda x: x["rank"] > F.col("own")), lambda x: F.struct(x["rank"].alias("rank"), x["anc"].alias("anc")))
    node = stored(_with_lineages(counts, lin, "left").select("taxid", "n", above.alias("above")), "counted")
    below = stored(node.select("n", F.explode("above.anc").alias("taxid")).groupBy("taxid").agg(F.sum("n").alias("weight")), "weights")
    inner = taxonomy.looked_up(stored(node.select("taxid", "n").join(taxonomy.looked_up(below), "taxid").select("taxid", "n", "weight"), "counted-inner"))
    # chains from each taxon that is nobody's parent up to the top, as arrays of (count, count and weight below, weight)
    leaf = node.join(inner.where("weight > 0"), "taxid", "left_anti").select("taxid", F.col("n").alias("own"), F.explode_outer("above").alias("a")).select("taxid", "own", "a.rank", "a.anc")
    chain = leaf.join(inner.withColumnRenamed("taxid", "anc"), "anc", "left").groupBy("taxid").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct((-F.col("rank")).alias("o"), "n", "weight")))).alias("c"))
    chain = chain.select("taxid", F.concat("c", F.array(F.struct(F.lit(1).alias("o"), F.col("own").alias("n"), F.lit(0.0).alias("weight")))).alias("c"))
    # down the chain: x arrives at a node, which passes (x + n) on by the next one's share
    down = F.aggregate("c", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("w")), lambda s, e: F.struct((F.when(s.w > 0, s.x * (e.n + e.weight) / s.w).otherwise(F.lit(0.0)) + e.n).alias("x"), e.weight.alias("w")))
    return chain.select("taxid", down.x.alias("n"))


def merge_candidates(results: DataFrame, lin: DataFrame, c: ClassifyParams) -> DataFrame:
    """(query_id, pos, taxid, hits) from (file, pos, query_id, taxid, hits) rows of several result files.

    Taxa below the lowest rank become their ancestor there; of each taxon the most hits count; ties go to the earlier file,
    then to the earlier place in its list. Unknown taxa are left out.
    """
    c = merge_params(c).resolved()
    known = lin.where("depth = 0").select("taxid", F.col("rank").alias("own"))
    low = taxonomy.ancestor_at(lin, c.lowest)
    d = results.join(known, "taxid").join(low, "taxid", "left").withColumn("taxid", F.when((F.col("own") < c.lowest) & F.col("anc").isNotNull(), F.col("anc")).otherwise(F.col("taxid")))
    best = d.groupBy("query_id", "taxid").agg(F.min(F.struct((-F.col("hits")).alias("neg"), "file", F.col("pos").alias("place"))).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.neg", "b.file", "b.place", "taxid")
    return best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= c.max_candidates).select("query_id", "pos", "taxid", (-F.col("b.neg")).alias("hits"))
