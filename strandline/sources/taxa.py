"""Readers for taxonomy dumps, accession mappings and result files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.naming import first_per_key
from ..params import NONE, RANK_SYNONYMS, RANKS, ROOT
from .sequences import list_files

_LINE = F.monotonically_increasing_id


def _fields(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(_LINE().alias("line"), F.split("value", r"\t?\|\t?").alias("f"))
    return d.where("size(f) > 1")


def rank_column(name: Column) -> Column:
    """The number of a rank's name; unknown ones are "none"."""
    table = {r: i for i, r in enumerate(RANKS)} | {k: RANKS.index(v) for k, v in RANK_SYNONYMS.items()}
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(name))], F.lit(NONE))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, name): the first scientific name, else the first name."""
    d = _fields(spark, path).select("line", F.get("f", 0).try_cast("long").alias("taxid"), F.get("f", 1).alias("name"), F.contains(F.coalesce(F.get("f", 3), F.lit("")), F.lit("scientific")).alias("sci"))
    d = d.where("taxid is not null").withColumn("late", (~F.col("sci")).cast("int"))
    return first_per_key(d, "taxid", ["late", "line"]).select("taxid", "name")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """(old, new)."""
    d = _fields(spark, path).select("line", F.get("f", 0).try_cast("long").alias("old"), F.get("f", 1).try_cast("long").alias("new")).where("old is not null")
    return first_per_key(d, "old", ["line"]).select("old", "new")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, parent, rank int)."""
    d = _fields(spark, path).select("line", F.get("f", 0).try_cast("long").alias("taxid"), F.get("f", 1).try_cast("long").alias("parent"), rank_column(F.get("f", 2)).cast("int").alias("rank")).where("taxid is not null")
    return first_per_key(d, "taxid", ["line"]).select("taxid", "parent", "rank")


def build_taxonomy(nodes: DataFrame, names: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(taxid, parent, name, rank): merged ids become taxa without name or rank below their new id, and are rewritten in
    nodes; of equal ids the merged one stays; a missing name is "--"; taxon 1 is the root."""
    if merged is not None:
        new = lambda c: F.coalesce(F.col(f"m_{c}"), F.col(c)).alias(c)
        for c in ("taxid", "parent"):
            nodes = nodes.join(merged.select(F.col("old").alias(c), F.col("new").alias(f"m_{c}")), c, "left")
        nodes = nodes.select(new("taxid"), new("parent"), "rank").groupBy("taxid").agg(F.min(F.struct("parent", "rank")).alias("v")).select("taxid", "v.parent", "v.rank")
        nodes = nodes.join(merged.select(F.col("old").alias("taxid")), "taxid", "left_anti")
    out = nodes.join(names, "taxid", "left").select("taxid", "parent", F.coalesce("name", F.lit("--")).alias("name"), F.when(F.col("taxid") == 1, ROOT).otherwise(F.col("rank")).cast("int").alias("rank"))
    if merged is not None:
        out = out.unionByName(merged.select(F.col("old").alias("taxid"), F.col("new").alias("parent"), F.lit("").alias("name"), F.lit(NONE).alias("rank")))
    return out


def read_taxonomy(spark: SparkSession, folder: str, merged: bool = True) -> DataFrame:
    return build_taxonomy(read_nodes(spark, f"{folder}/nodes.dmp"), read_names(spark, f"{folder}/names.dmp"), read_merged(spark, f"{folder}/merged.dmp") if merged else None)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, acc, accver, taxid, gi): four columns behind a header line."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _LINE().alias("row"), F.split("value", r"\s+").alias("f"))
    return d.select("file", "row", F.get("f", 0).alias("acc"), F.get("f", 1).alias("accver"), F.get("f", 2).try_cast("long").alias("taxid"), F.get("f", 3).alias("gi")).where("taxid is not null")


def read_assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """(key, taxid): columns are found by name in the last of the leading "#" lines; without such, the first two count."""
    head = [r.value for r in spark.read.text(path).limit(10).collect()]
    lead = []
    for line in head:
        if not line.startswith("#"):
            break
        lead.append(line)
    names = re.split(r"\t", lead[-1].lstrip("# ")) if lead else []
    key = next((names.index(n) for n in ("assembly_accession", "accession.version") if n in names), 0)
    tax = names.index("taxid") if "taxid" in names else 1
    d = spark.read.text(path).where("value not like '#%'").select(_LINE().alias("line"), F.split("value", r"\t").alias("f"))
    d = d.select("line", F.get("f", key).alias("key"), F.get("f", tax).try_cast("long").alias("taxid")).where("taxid is not null")
    return first_per_key(d, "key", ["line"]).select("key", "taxid")


def post_mapping_files(names: list[str], extra: list[str] = ()) -> list[str]:
    """The order in which accession mappings are tried: those given, the four usual ones, then any other of that kind."""
    usual = [f"nucl_{x}.accession2taxid" for x in ("gb", "wgs", "est", "gss")]
    base = {n.rsplit("/", 1)[-1]: n for n in names}
    found = [base[u] for u in usual if u in base]
    return [*extra, *found, *sorted(n for n in names if n.endswith(".accession2taxid") and n not in found)]


def mapping_files(spark: SparkSession, folder: str) -> list[str]:
    """The accession mappings in a taxonomy folder, in the order in which they are tried."""
    return post_mapping_files([f for f in list_files(spark, folder) if f.endswith(".accession2taxid")])


#: Fixed value: the usual name of the summary that lies beside sequence files.
SUMMARY_NAME = "assembly_summary.txt"


def summary_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Assembly summaries in the folders that hold the sequence files."""
    folders = {f.rsplit("/", 1)[0] for p in paths for f in list_files(spark, p)}
    return sorted(f for folder in folders for f in list_files(spark, folder) if f == f"{folder}/{SUMMARY_NAME}")


def read_results(spark: SparkSession, path: str, separator: str = "\t|\t") -> DataFrame:
    """(file, query_id, header, pos, taxid, hits) of one result file: one row for each top hit.

    Raises ValueError if the file has no layout line, was made at sequence level, or lacks query ids or top hits.
    """
    # of all comment lines only those of the two kinds, which a result has once for each file that was written
    lead = [r.value for r in spark.read.text(path).where("value like '#%' and (contains(value, 'Classification') or contains(value, 'TABLE_LAYOUT:'))").distinct().collect()]
    if not any("Classification" in x and "sequence" not in x for x in lead):
        raise ValueError(f"{path} has no classification above sequence level")
    layout = next((x.split("TABLE_LAYOUT:", 1)[1].strip() for x in lead if "TABLE_LAYOUT:" in x), "")
    columns = [c.strip() for c in re.split(r"\s*\|\s*" if "|" in separator else re.escape(separator), layout)]
    if not columns or columns[0] != "query_id" or "top_hits" not in columns:
        raise ValueError(f"{path} has no query ids or no top hits")
    f = F.split("value", r"\s*\|\s*" if "|" in separator else re.escape(separator))
    d = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    header = columns.index("query_header") if "query_header" in columns else 1
    d = d.select(F.lit(path).alias("file"), f[0].try_cast("long").alias("query_id"), F.get(f, header).alias("header"), F.posexplode(F.split(F.get(f, columns.index("top_hits")), ",")).alias("pos", "hit"))
    hit = F.split("hit", ":")
    return d.select("file", "query_id", "header", "pos", hit[0].try_cast("long").alias("taxid"), F.get(hit, 1).try_cast("long").alias("hits")).where("taxid is not null and hits is not null")
