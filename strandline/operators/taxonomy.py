"""Lineages, ancestors and lowest common ancestors over (taxid, parent, name, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import NONE, NUM_RANKS
from ..storage import bounded_broadcast, stored


#: What a row of ids takes in a broadcast table, as measured.
_ROW_BYTES = 100


def looked_up(df: DataFrame) -> DataFrame:
    """df (stored) for joins by taxon: broadcast if its counted rows prove that it is small, else shuffled, whatever the size of its
    files makes Spark expect; ids pack so well that a table of many rows looks small."""
    small = bounded_broadcast(df, _ROW_BYTES)
    return df.hint("merge") if small is df else small


def lineages(taxa: DataFrame) -> DataFrame:
    """(taxid, anc, depth, rank): every taxon with itself (depth 0) and its ancestors, with the ancestor's rank.

    Ends at a taxon that is its own parent or whose parent is missing. The recursion limits of the session are raised. Only taxa
    that are parents take part in the recursion, whose result is stored; the others, mostly many more, take what their parents have.
    """
    spark = taxa.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
    t = taxa.select(F.col("taxid").cast("long").alias("taxid"), F.col("parent").cast("long").alias("parent"), F.col("rank").cast("int").alias("rank"))
    parents = looked_up(stored(t.select(F.col("parent").alias("taxid")).distinct(), "parents"))
    inner = stored(t.join(parents, "taxid", "left_semi").select("taxid", "parent", "rank"), "inner-taxa")
    above = spark.sql(
        """
        WITH RECURSIVE lin(taxid, anc, depth, rank, parent) AS (
          SELECT taxid, taxid, 0, rank, parent FROM {t}
          UNION ALL
          SELECT l.taxid, t.taxid, l.depth + 1, t.rank, t.parent FROM lin l JOIN {up} t ON t.taxid = l.parent WHERE l.parent <> l.anc
        ) SELECT taxid, anc, depth, rank FROM lin""",
        t=inner,
        up=looked_up(inner),
    )
    above = stored(above, "inner-lineages")
    leaf = t.join(parents, "taxid", "left_anti")
    own = leaf.select("taxid", F.col("taxid").alias("anc"), F.lit(0).alias("depth"), "rank")
    up = looked_up(above).select(F.col("taxid").alias("parent"), "anc", (F.col("depth") + 1).alias("depth"), F.col("rank").alias("r"))
    return above.unionByName(own).unionByName(leaf.join(up, "parent").select("taxid", "anc", "depth", F.col("r").alias("rank")))


def ranked(lin: DataFrame) -> DataFrame:
    """(taxid, rank, anc): the ancestor at each rank; of several the farthest; taxa without rank are left out."""
    return lin.where(F.col("rank") < NONE).groupBy("taxid", "rank").agg(F.max_by("anc", "depth").alias("anc"))


def ranked_arrays(lin: DataFrame) -> DataFrame:
    """(taxid, own, ranks) of every taxon: its own rank, and an array of NUM_RANKS ancestors, null where there is none."""
    own = F.max(F.when(F.col("depth") == 0, F.col("rank"))).alias("own")
    at = [F.max_by(F.when(F.col("rank") == r, F.col("anc")), F.when(F.col("rank") == r, F.col("depth"))).alias(f"r{r}") for r in range(NUM_RANKS)]
    return lin.groupBy("taxid").agg(own, *at).select("taxid", "own", F.array(*(f"r{r}" for r in range(NUM_RANKS))).alias("ranks"))


def ancestor_at(lin: DataFrame, rank: int) -> DataFrame:
    """(taxid, anc): the ancestor at one rank, where there is one."""
    return ranked(lin).where(F.col("rank") == rank).select("taxid", "anc")


def next_ranked(lin: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxid, anc): a taxon itself if it has a rank above sequence, else its first ancestor that has."""
    first = ranked(lin).where("rank > 0").groupBy("taxid").agg(F.min_by("anc", "rank").alias("up"))
    own = taxa.select("taxid", "rank")
    return own.join(first, "taxid", "left").select("taxid", F.when((F.col("rank") > 0) & (F.col("rank") < NONE), F.col("taxid")).otherwise(F.col("up")).alias("anc"))


def lca_full(pairs: DataFrame, lin: DataFrame) -> DataFrame:
    """(a, b, lca): the nearest common ancestor on whole lineages; null if there is none. One row for each pair all the way:
    a lineage is an array, from the taxon up."""
    up = lin.groupBy("taxid").agg(F.array_sort(F.collect_list(F.struct("depth", "anc"))).alias("up"))
    own = lambda c: up.select(F.col("taxid").alias(c), F.col("up.anc").alias(f"up_{c}"))
    d = pairs.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    return d.select("a", "b", F.get(F.array_intersect("up_a", "up_b"), F.lit(0)).alias("lca"))


def lca_ranked(pairs: DataFrame, lin: DataFrame) -> DataFrame:
    """(a, b, lca, rank): the lowest rank at which both have the same taxon; nulls if there is none."""
    r = ranked(lin)
    la, lb = r.withColumnRenamed("taxid", "a"), r.withColumnRenamed("taxid", "b")
    both = pairs.select("a", "b").join(la, "a").join(lb, ["b", "rank", "anc"]).groupBy("a", "b").agg(F.min(F.struct("rank", "anc")).alias("m"))
    return pairs.select("a", "b").join(both, ["a", "b"], "left").select("a", "b", F.col("m.anc").alias("lca"), F.col("m.rank").alias("rank"))


def covered(lin: DataFrame) -> DataFrame:
    """(taxid, n): how many sequences have the taxon in their lineage; sequences have ids below 0."""
    return lin.where("taxid < 0").groupBy(F.col("anc").alias("taxid")).agg(F.count("*").alias("n"))


def sequences_per_taxon(lin: DataFrame, rank: int) -> DataFrame:
    """(taxid, n): sequences below each taxon of a rank; null collects those without an ancestor there."""
    own = lin.where("taxid < 0").select("taxid").distinct()
    return own.join(ancestor_at(lin, rank), "taxid", "left").groupBy(F.col("anc").alias("taxid")).agg(F.count("*").alias("n"))


def insert_or_replace(taxa: DataFrame, new: DataFrame) -> DataFrame:
    return taxa.join(new.select("taxid"), "taxid", "left_anti").unionByName(new)


def erase_above(taxa: DataFrame, rank: int) -> DataFrame:
    """Without taxa of higher ranks."""
    return taxa.where(F.col("rank") <= rank)


def reset_parents(taxa: DataFrame, parents: DataFrame) -> DataFrame:
    """taxa with parents (taxid, new_parent) put in where given."""
    d = taxa.join(parents.select("taxid", "new_parent"), "taxid", "left")
    return d.withColumn("parent", F.coalesce("new_parent", "parent")).drop("new_parent")
