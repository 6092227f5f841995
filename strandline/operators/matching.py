"""Probing the index with reads, and candidates for each read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import ClassifyParams, SketchParams


def probe(features: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, tgt, win, hits): matches of (query_id, feature, n) with the index; a feature counts once for each of the
    read's windows that has it."""
    return features.join(index, "feature").groupBy("query_id", "tgt", "win").agg(F.sum("n").alias("hits"))


def window_span(reads: DataFrame, p: SketchParams, insert_size: int = 0) -> DataFrame:
    """(query_id, span): how many consecutive windows of a target a read may lie in."""
    length = F.greatest(F.length("seq1") + F.coalesce(F.length("seq2"), F.lit(0)), F.lit(insert_size))
    return reads.select("query_id", (F.floor(length / p.stride) + 2).cast("int").alias("span"))


def _ranges() -> Column:
    """For each window of a sorted array m: windows of the last span up to it, their hits and the first of them.

    At most span entries before an entry can be that near, so the work grows with the array's length alone.
    """

    def one(e: Column, i: Column) -> Column:
        before = F.transform(F.sequence(F.greatest(F.lit(0), i - F.col("span") + 1), i), lambda j: F.get("m", j))
        near = F.filter(before, lambda x: x.win > e.win - F.col("span"))
        return F.struct((-F.aggregate(near, F.lit(0).cast("long"), lambda s, x: s + x.hits)).alias("neg"), e.win.alias("end"), near[0].win.alias("beg"))

    return F.transform("m", one)


def _gathered(hits: DataFrame, spans: DataFrame) -> DataFrame:
    m = hits.groupBy("query_id", "tgt").agg(F.array_sort(F.collect_list(F.struct("win", "hits"))).alias("m"))
    return m.join(spans, "query_id").select("query_id", "tgt", _ranges().alias("r"))


def all_window_ranges(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, tgt, beg, end, hits): the range that ends at each matched window."""
    r = _gathered(hits, spans).select("query_id", "tgt", F.explode("r").alias("r"))
    return r.select("query_id", "tgt", "r.beg", "r.end", (-F.col("r.neg")).alias("hits"))


def best_window_range(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, tgt, beg, end, hits): of each target the range with most hits, the first of several."""
    r = _gathered(hits, spans).withColumn("b", F.array_min("r"))
    return r.select("query_id", "tgt", "b.beg", "b.end", (-F.col("b.neg")).alias("hits"))


def top_candidates(best: DataFrame, most: int) -> DataFrame:
    """(query_id, pos, tgt, hits, beg, end): the most best targets, ties by target; pos counts from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "tgt")
    return best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def top_taxa(best: DataFrame, taxon_of: DataFrame, most: int) -> DataFrame:
    """(query_id, pos, taxid, tgt, hits, beg, end): candidates by taxon.

    taxon_of (tgt, taxid) has each target's taxon at the lowest wanted rank, or its own. Of a taxon's targets the one with
    most hits counts, the first of several.
    """
    d = best.join(taxon_of, "tgt").groupBy("query_id", "taxid").agg(F.min(F.struct((-F.col("hits")).alias("neg"), "tgt", "beg", "end")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.neg", "b.tgt")
    d = d.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return d.select("query_id", "pos", "taxid", "b.tgt", (-F.col("b.neg")).alias("hits"), "b.beg", "b.end")


def candidates(reads: DataFrame, features: DataFrame, index: DataFrame, taxon_of: DataFrame, p: SketchParams, c: ClassifyParams) -> DataFrame:
    """All of the above in a row."""
    best = best_window_range(probe(features, index), window_span(reads, p, c.insert_size))
    return top_taxa(best, taxon_of, c.max_candidates)


def hits_per_target(hits: DataFrame) -> DataFrame:
    """(tgt, query_id, list): "window:hits" of each read, in window order."""
    m = hits.groupBy("tgt", "query_id").agg(F.array_sort(F.collect_list(F.struct("win", "hits"))).alias("m"))
    return m.select("tgt", "query_id", F.array_join(F.transform("m", lambda x: F.concat(x.win.cast("string"), F.lit(":"), x.hits.cast("string"))), "/").alias("list"))
