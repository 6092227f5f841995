"""Joins by sequence names, and taxon assignment of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def similar_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(acc, similar): of the names that continue acc the smallest; null if there is none.

    Names that continue acc follow it in sorted order without any other between, so the next name decides. Both sides are
    sorted together in ranges of about equal size; a range's last rows are followed by the first name of a later range,
    of which there is one for each range. No name is copied, and a short acc that very many continue is one row like others.
    """
    acc = wanted.select("acc").where("acc is not null and acc <> ''").distinct()
    rows = names.select(F.col("name").alias("key"), F.lit(1).alias("named")).where("key is not null").distinct().unionByName(acc.select(F.col("acc").alias("key"), F.lit(0).alias("named")))
    ranges = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "names")
    first = rows.groupBy("range").agg(F.min(F.when(F.col("named") == 1, F.col("key"))).alias("first"))  # a row for each range
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = first.select("range", F.last("first", ignorenulls=True).over(later).alias("carried"))
    # from the last key down; an acc comes before a name that equals it, which does not continue it
    down = Window.partitionBy("range").orderBy(F.desc("key"), "named").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("named") == 1, F.col("key")), ignorenulls=True).over(down)
    found = rows.withColumn("near", near).where("named = 0").join(F.broadcast(carried), "range")
    similar = F.coalesce("near", "carried")
    return found.select(F.col("key").alias("acc"), F.when(similar.startswith(F.col("key")), similar).alias("similar"))


def taxon_of_names(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """(acc, taxid): of (acc) in (key, taxid) by equal key, else by the smallest key that continues acc; null if neither."""
    exact = mapping.select(F.col("key").alias("acc"), F.col("taxid").alias("t1"))
    near = similar_names(wanted, mapping.select(F.col("key").alias("name")))
    second = mapping.select(F.col("key").alias("similar"), F.col("taxid").alias("t2"))
    d = wanted.select("acc").distinct().join(exact, "acc", "left").join(near, "acc", "left").join(second, "similar", "left")
    return d.select("acc", F.coalesce("t1", "t2").alias("taxid"))


def resolve_parents(targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """(tgt, parent): by the sequence id, else by the file id, else the taxid in the header; 0 below 1.

    targets is (tgt, seq_id, file_id, header_taxid), mapping (key, taxid).
    """
    by_seq = taxon_of_names(targets.select(F.col("seq_id").alias("acc")), mapping).select(F.col("acc").alias("seq_id"), F.col("taxid").alias("a"))
    by_file = taxon_of_names(targets.select(F.col("file_id").alias("acc")), mapping).select(F.col("acc").alias("file_id"), F.col("taxid").alias("b"))
    d = targets.join(by_seq, "seq_id", "left").join(by_file, "file_id", "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return d.select("tgt", F.coalesce(positive("a"), positive("b"), positive("header_taxid"), F.lit(0)).cast("long").alias("parent"))


def rank_unranked(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """(tgt, parent): for targets without parent the taxon of the first mapping row that fits.

    targets is (tgt, name, parent), rows (file, row, acc, accver, gi, taxid). A row fits the target named accver, else the
    one with the smallest name that continues acc, else the one named gi.
    """
    open_ = targets.where("coalesce(parent, 0) = 0").select("tgt", "name")
    by_name = targets.groupBy("name").agg(F.min("tgt").alias("tgt"))
    near = similar_names(rows.select("acc"), targets)
    r = rows.join(near, "acc", "left")
    for key in ("accver", "similar", "gi"):
        r = r.join(by_name.select(F.col("name").alias(key), F.col("tgt").alias(f"t_{key}")), key, "left")
    r = r.withColumn("tgt", F.coalesce("t_accver", "t_similar", "t_gi")).where("tgt is not null")
    first = r.groupBy("tgt").agg(F.min(F.struct("file", "row", "taxid")).alias("m"))
    return open_.join(first, "tgt").select("tgt", F.col("m.taxid").alias("parent"))


def pair_consecutive(sequences: DataFrame) -> DataFrame:
    """(query_id, header, seq1, seq2) of (index from 1, header, data): neighbours are mates; an odd last one is left out."""
    first = sequences.where("index % 2 = 1").select(((F.col("index") + 1) / 2).cast("long").alias("query_id"), "header", F.col("data").alias("seq1"))
    second = sequences.where("index % 2 = 0").select((F.col("index") / 2).cast("long").alias("query_id"), F.col("data").alias("seq2"))
    return first.join(second, "query_id")


def pair_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, header, seq1, seq2): records of equal index; the shorter file ends it."""
    return a.select(F.col("index").alias("query_id"), "header", F.col("data").alias("seq1")).join(b.select(F.col("index").alias("query_id"), F.col("data").alias("seq2")), "query_id")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
