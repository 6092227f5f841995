"""Sequences, reads and taxa derived from the test tables, which hold no sequences of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import dna_of
from ..params import RANKS, SketchParams
from ..storage import spread

DOMAIN, SPECIES, PHYLUM = (RANKS.index(x) for x in ("domain", "species", "phylum"))
#: Short k-mers, since reads are prose and share no long ones by chance.
CLASSIFY, CROWDED = SketchParams(10, 16, 128), SketchParams(8, 16, 128)
WIDE, SYNCMERS = SketchParams(21, 16, 128), SketchParams(10, 16, 128, sketcher="syncmer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id() -> Column:
    lang = F.col("lang")
    return (F.ascii(lang) - 97 + 26 * (F.ascii(F.substring(lang, 2, 1)) - 97) + 1).cast("long") * 1000


def species_id() -> Column:
    return language_id() + F.regexp_extract("source", "([0-9]+)", 1).cast("long") + 1


def targets(spark: SparkSession, sf_dir: str, part_bytes: int | None = None, of: str = "true") -> DataFrame:
    """(tgt, name, taxid, lang, source, dna): one target for each document for which the condition of holds; part_bytes as in spread()."""
    d = spread(table(spark, sf_dir, "documents").where(of).select("doc_id", "text", "lang", "source"), part_bytes)
    return d.select(F.col("doc_id").alias("tgt"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), (-F.col("doc_id") - 1).alias("taxid"), "lang", "source", dna_of(F.col("text")).alias("dna"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, header, seq1, seq2): one read for each benchmark item."""
    d = table(spark, sf_dir, "benchmark")
    return d.select((F.col("item_id") + 1).alias("query_id"), F.concat(F.lit("read_"), F.col("item_id").cast("string"), F.lit(" item")).alias("header"), dna_of(F.col("text")).alias("seq1"), F.lit("").alias("seq2"))


def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive items as mates."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), dna_of(F.col("text")).alias("data"))
    a, b = d.where("i % 2 = 0"), d.where("i % 2 = 1").select((F.col("i") - 1).alias("i"), F.col("data").alias("seq2"))
    return a.join(b, "i").select((F.col("i") / 2 + 1).cast("long").alias("query_id"), F.concat(F.lit("pair_"), F.col("i").cast("string")).alias("header"), F.col("data").alias("seq1"), "seq2")


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxid, parent, name, rank): root, a domain for each language, a species for each language and source, documents.

    Ids come from the letters of names: 1000 * (a + 26 * b) for the first two letters of a language, and that plus one more
    than the number in a source's name.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    d = d.withColumn("l", language_id()).withColumn("s", species_id())
    root = spark.range(1).select(F.lit(1).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("root").alias("name"), F.lit(20).alias("rank"))
    domains = d.select("l", "lang").distinct().select(F.col("l").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.col("lang").alias("name"), F.lit(DOMAIN).alias("rank"))
    species = d.select("l", "s", "lang", "source").distinct().select(F.col("s").alias("taxid"), F.col("l").alias("parent"), F.concat_ws(" ", "lang", "source").alias("name"), F.lit(SPECIES).alias("rank"))
    own = d.select((-F.col("doc_id") - 1).alias("taxid"), F.col("s").alias("parent"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.lit(0).alias("rank"))
    return root.unionByName(domains).unionByName(species).unionByName(own)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deeper tree: root, regions, nations, customers and suppliers; customers have no rank where the key divides by 7."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda i, p, n, r: (i.cast("long").alias("taxid"), p.cast("long").alias("parent"), n.alias("name"), r.cast("int").alias("rank"))
    c, lit = F.col, F.lit
    out = spark.range(1).select(*row(lit(1), lit(1), lit("root"), lit(20)))
    out = out.unionByName(t("region").select(*row(c("r_regionkey") + 10, lit(1), c("r_name"), lit(DOMAIN))))
    out = out.unionByName(t("nation").select(*row(c("n_nationkey") + 100, c("n_regionkey") + 10, c("n_name"), lit(PHYLUM))))
    out = out.unionByName(t("supplier").select(*row(c("s_suppkey") + 1_000_000, c("s_nationkey") + 100, c("s_name"), lit(SPECIES))))
    return out.unionByName(t("customer").select(*row(c("c_custkey") + 2_000_000, c("c_nationkey") + 100, c("c_name"), F.when(c("c_custkey") % 7 == 0, 21).otherwise(SPECIES))))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, truth_taxid): item i is said to come from document 3 i; every fifth has no known truth."""
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select((i + 1).alias("query_id"), F.when(i % 5 != 4, -3 * i - 1).alias("truth_taxid"))
