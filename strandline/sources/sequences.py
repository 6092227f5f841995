"""Readers for sequence files: (file string, index long, header string, data string, qualities string)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of file names by format.
FASTA_ENDINGS, FASTQ_ENDINGS = (".fa", ".fna", ".fasta"), (".fq", ".fnq", ".fastq")
SCHEMA = "file string, index long, header string, data string, qualities string"


class FormatError(ValueError):
    """A file is not in the format it is read as."""


def _lines(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def _located(spark: SparkSession, paths: list[str], recursive: bool, start: str) -> DataFrame:
    """Records of files read by a separator that begins each of them, with their order in the file.

    The text source deals a large file out by records, in ascending order of partitions; the order in a file is the rank of
    the partition's first row, counted per partition first, so that no file meets in one task.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", start).text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def _numbered(df: DataFrame) -> DataFrame:
    """df (file, block, line, ...) with index, from 1 in each file, by (block, line): blocks are counted, then added up."""
    size = df.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = size.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("line"))
    return df.withColumn("__i", inside).join(F.broadcast(before), ["file", "block"]).withColumn("index", F.col("__i") + F.col("before")).drop("__i", "before")


def read_fasta(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """FASTA records: a line ">header", then any number of lines of letters. Records without letters, and files that do not
    begin with ">", raise FormatError when the rows are computed."""
    raw = _located(spark, list(paths), recursive, "\n>")
    parts = F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n", 2)
    first = (F.col("block") == 0) & (F.col("__i0") == 1)
    raw = raw.withColumn("__i0", F.row_number().over(Window.partitionBy("file", "block").orderBy("line")))
    header = F.when(first, F.when(parts[0].startswith(">"), F.substring(parts[0], F.lit(2), F.length(parts[0]))).otherwise(F.raise_error(F.concat(F.lit("no '>' at the start of "), F.col("file"))))).otherwise(parts[0])
    data = F.coalesce(F.get(parts, 1), F.lit(""))
    for space in "\n \t\r\v\f":
        data = F.replace(data, F.lit(space), F.lit(""))
    data = F.when(F.length(data) > 0, data).otherwise(F.raise_error(F.concat(F.lit("a record without letters in "), F.col("file"))))
    d = raw.where("length(trim(value)) > 0").select("file", "block", "line", header.alias("header"), data.alias("data"))
    return _numbered(d).select("file", "index", "header", "data", F.lit("").alias("qualities"))


def read_fastq(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """FASTQ records of four lines: "@header", letters, "+...", qualities; a blank line ends a file's records."""
    d = _numbered(_lines(spark, list(paths), recursive))
    blank = d.where("trim(value) = ''").groupBy("file").agg(F.min("index").alias("stop"))
    d = d.join(F.broadcast(blank), "file", "left").where("stop is null or index < stop")
    part = lambda i: F.max(F.when((F.col("index") - 1) % 4 == i, F.col("value")))
    r = d.groupBy("file", F.floor((F.col("index") - 1) / 4).alias("i")).agg(*(part(i).alias(f"l{i}") for i in range(4)))
    ok = F.col("l0").startswith("@") & F.col("l2").startswith("+") & F.col("l3").isNotNull()
    header = F.when(F.coalesce(ok, F.lit(False)), F.substring(F.col("l0"), F.lit(2), F.length("l0"))).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record in "), F.col("file"))))
    return r.select("file", (F.col("i") + 1).alias("index"), header.alias("header"), F.col("l1").alias("data"), F.col("l3").alias("qualities"))


def over_files(records: DataFrame) -> DataFrame:
    """Records of files with indexes that count on from file to file, in the order of names; one row for each file is added up."""
    size = records.groupBy("file").agg(F.max("index").alias("n"))
    before = size.select("file", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return records.join(F.broadcast(before), "file").withColumn("index", F.col("index") + F.col("before")).drop("before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, value): the lines of one file in order."""
    return _numbered(_lines(spark, [path], False)).select("index", "value")


def read_headers(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """(file, index, header) of lines that begin with ">" or "@"."""
    d = _lines(spark, list(paths), recursive).where(F.col("value").rlike("^[>@]"))
    return _numbered(d).select("file", "index", F.substring(F.col("value"), F.lit(2), F.length("value")).alias("header"))


def format_of(path: str, first: str = "") -> str:
    """"fasta" or "fastq", by the name's ending, else by the first character."""
    low = path.lower()
    if low.endswith(FASTQ_ENDINGS) or not low.endswith(FASTA_ENDINGS) and first.startswith("@"):
        return "fastq"
    if low.endswith(FASTA_ENDINGS) or first.startswith(">"):
        return "fasta"
    raise FormatError(f"{path} is neither FASTA nor FASTQ")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files below a path in the order of their names, without hidden ones ("_" and "." in front); a file is itself."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName()[0] not in "_.":
            out.append(f.toString())
    return sorted(out)


def first_letter(spark: SparkSession, path: str) -> str:
    """The first byte of a file as a character, or nothing; no job is run for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p)
    try:
        byte = stream.read()
    finally:
        stream.close()
    return chr(byte) if byte >= 0 else ""


def read_sequences(spark: SparkSession, *paths: str) -> DataFrame:
    """FASTA and FASTQ files of any mixture."""
    groups: dict[str, list[str]] = {"fasta": [], "fastq": []}
    for path in paths:
        for f in list_files(spark, path):
            known = f.lower().endswith(FASTA_ENDINGS + FASTQ_ENDINGS)
            groups[format_of(f, "" if known else first_letter(spark, f))].append(f)
    out = spark.createDataFrame([], SCHEMA)
    if groups["fasta"]:
        out = out.unionByName(read_fasta(spark, *groups["fasta"]))
    if groups["fastq"]:
        out = out.unionByName(read_fastq(spark, *groups["fastq"]))
    return out
