"""FASTA and FASTQ files by records: reading begins at any record or byte, and only the blocks behind it are parsed.

A file is dealt out in blocks of bytes; a record belongs to the block that its first byte lies in, and is read to its end from
there. Starts are found without the bytes before: a FASTA record at a line that begins with ">", a FASTQ record at a line that
begins with "@" and whose second next one begins with "+" (a line of qualities may begin with "@", but then the second next
line holds letters). An index with the number of records in each block is made by one pass, in tasks; with it, a first
record and a limit choose the blocks that are opened, and every record knows its number and its first byte.

A blank line ends a FASTQ file's records; blocks behind it would not know of it, so nothing should follow one.
Files are opened by pyarrow's file systems, which know local and network paths by their URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .sequences import FormatError, format_of, list_files

BLOCK = 16 << 20
_READ = 1 << 20
_BATCH_BYTES = 4 << 20
BLOCKS = "file string, kind string, start long, stop long"
SCHEMA = "file string, offset long, index long, header string, data string, qualities string"


@dataclass
class Block(InputPartition):
    """Records of a file whose first byte lies in [start, stop): number is that of the first one (0: not known), of these
    skip are left out, and at most the next take are read (below 0: all)."""

    file: str
    kind: str
    start: int
    stop: int
    number: int = 0
    skip: int = 0
    take: int = -1


def _open(path: str) -> tuple[pa.NativeFile, int]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        system, name = fs.LocalFileSystem(), unquote(url.path) if url.scheme else path
    else:
        system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name), system.get_file_info(name).size


class Lines:
    """Lines of a file from a byte on: (offset, line without its end); a line that begins before that byte is left out.

    at: the byte behind the line given last; ended: whether that line has a line feed.
    """

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.at = file, max(0, start - 1)
        file.seek(self.at)
        self.held, self.used, self.done, self.ended = b"", 0, False, False
        if start > 0:
            next(self, None)  # up to the end of the line that byte start - 1 lies in: nothing is lost if that byte ends a line

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        return self

    def __next__(self) -> tuple[int, bytes]:
        while (end := self.held.find(b"\n", self.used)) < 0 and not self.done:
            rest = self.held[self.used :]
            more = self.file.read(max(_READ, len(rest)))  # doubled, so that a long line is copied a few times alone
            self.held, self.used, self.done = rest + more, 0, not more
        self.ended = end >= 0
        if not self.ended and self.used == len(self.held):
            raise StopIteration
        line, at = self.held[self.used : end if self.ended else len(self.held)], self.at
        self.used += len(line) + self.ended
        self.at += len(line) + self.ended
        return at, line.removesuffix(b"\r")


def fasta_records(lines: Iterator[tuple[int, bytes]], stop: int, file: str) -> Iterator[tuple[int, str, str, str]]:
    """(offset, header, letters, "") of records that start before stop."""
    at, header, parts = -1, b"", []
    for offset, line in lines:
        if line[:1] != b">":
            if at < 0 and offset == 0 and line.strip():
                raise FormatError(f"no '>' at the start of {file}")
            if at >= 0:
                parts.append(b"".join(line.split()))
            continue
        if at >= 0:
            yield _fasta(at, header, parts, file)
        if offset >= stop:
            return
        at, header, parts = offset, line[1:], []
    if at >= 0:
        yield _fasta(at, header, parts, file)


def _fasta(at: int, header: bytes, parts: list[bytes], file: str) -> tuple[int, str, str, str]:
    data = b"".join(parts)
    if not data:
        raise FormatError(f"a record without letters in {file}")
    return at, header.decode("utf-8", "replace"), data.decode("utf-8", "replace"), ""


def fastq_records(lines: Iterator[tuple[int, bytes]], start: int, stop: int, file: str) -> Iterator[tuple[int, str, str, str]]:
    """(offset, header, letters, qualities) of records that start before stop; a blank header line ends the block's."""
    four: list[tuple[int, bytes]] = []
    found = start == 0
    for offset, line in lines:
        four.append((offset, line))
        while not found and len(four) >= 3 and not (found := four[0][1][:1] == b"@" and four[2][1][:1] == b"+"):
            four.pop(0)
        if not found:
            continue
        if four[0][0] >= stop or not four[0][1].strip():
            return
        if len(four) == 4:
            if four[0][1][:1] != b"@" or four[2][1][:1] != b"+":
                raise FormatError(f"not a FASTQ record in {file}")
            yield four[0][0], *(x[1].decode("utf-8", "replace") for x in ((0, four[0][1][1:]), four[1], four[3]))
            four = []
    if found and four and four[0][1].strip() and four[0][0] < stop:
        raise FormatError(f"not a FASTQ record in {file}")


def records(b: Block) -> Iterator[tuple[int, str, str, str]]:
    """All records of a block."""
    file, _ = _open(b.file)
    with file:
        lines = Lines(file, b.start)
        yield from fasta_records(lines, b.stop, b.file) if b.kind == "fasta" else fastq_records(lines, b.start, b.stop, b.file)


class _Reader(DataSourceReader):
    """One partition for each block."""

    def __init__(self, blocks: list[Block]) -> None:
        self.blocks = blocks

    def partitions(self) -> list[Block]:
        return self.blocks

    def read(self, b: Block) -> Iterator[pa.RecordBatch]:
        rows, held, n = [], 0, 0
        for n, r in enumerate(records(b)):
            if n < b.skip:
                continue
            if 0 <= b.take <= n - b.skip:
                break
            rows.append((b.file, r[0], b.number + n if b.number else None, *r[1:]))
            held += len(r[1]) + len(r[2]) + len(r[3])
            if held >= _BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "offset", "index", "header", "data", "qualities"])


class _Stream(SimpleDataSourceStreamReader):
    """A stream over a file that grows: the offset is the byte behind the last whole record that was read."""

    def __init__(self, file: str, kind: str, first: int, most: int) -> None:
        self.file, self.kind, self.first, self.most = file, kind, first, most

    def initialOffset(self) -> dict:
        return {"byte": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start["byte"]
        whole = _whole_bytes(self.file, self.kind, at)
        for r in records(Block(self.file, self.kind, at, whole)):
            if len(rows) == self.most:
                return iter(rows), {"byte": r[0]}
            rows.append((self.file, r[0], None, *r[1:]))
        return iter(rows), {"byte": max(at, whole)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.file, r[0], None, *r[1:]) for r in records(Block(self.file, self.kind, start["byte"], end["byte"]))])


def _whole_bytes(path: str, kind: str, start: int) -> int:
    """The byte behind the last record that is surely whole: of FASTA, the last record's own start, since more letters may
    come; of FASTQ, the end of the last four whole lines."""
    file, _ = _open(path)
    with file:
        lines, last, n = Lines(file, start), start, 0
        for offset, line in lines:
            if kind == "fasta":
                last = offset if line[:1] == b">" else last
            elif lines.ended:  # its end of line is there
                n += 1
                last = lines.at if n % 4 == 0 else last
        return last


class SequenceRecords(DataSource):
    """Spark's data source "sequence_records". Options: blocks (JSON) for tables; path, kind, first and most for streams."""

    @classmethod
    def name(cls) -> str:
        return "sequence_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([Block(*b) for b in json.loads(self.options["blocks"])])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"], self.options["kind"], int(self.options.get("first", 0)), int(self.options.get("most", 10_000)))


def _source(spark: SparkSession, blocks: list[tuple]) -> DataFrame:
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(SequenceRecords)
    return spark.read.format("sequence_records").option("blocks", json.dumps(blocks)).load()


def blocks_of(spark: SparkSession, paths: list[str], block: int = BLOCK) -> DataFrame:
    """(file, kind, start, stop) of all blocks of files and folders; sizes are asked from the file system, nothing is read."""
    rows = []
    for path in (f for p in paths for f in list_files(spark, p)):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).getLen()
        known = format_of(path, "@" if path.lower().endswith("q") else ">")
        rows.append((path, known, size))
    files = spark.createDataFrame(rows, "file string, kind string, size long").where("size > 0")
    each = files.select("file", "kind", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block))).alias("i"))
    return each.select("file", "kind", (F.col("i") * block).alias("start"), F.least(F.col("size"), (F.col("i") + 1) * block).alias("stop"))


def record_index(spark: SparkSession, paths: list[str], block: int = BLOCK) -> DataFrame:
    """(file, kind, start, stop, n, first): records of each block and the number of its first one, counted in tasks.

    Store it and give it to read_records() again and again. Numbers start at 1 in each file.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(1 for _ in records(Block(*r))) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["file", "kind", "start", "stop", "n"])

    blocks = blocks_of(spark, paths, block)
    counted = blocks.repartition(max(1, spark.sparkContext.defaultParallelism), "file", "start").mapInArrow(count, BLOCKS + ", n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("first", before + 1)


def read_records(spark: SparkSession, index: DataFrame, first: int = 1, limit: int | None = None) -> DataFrame:
    """(file, offset, index, header, data, qualities): of each file the records from number first on, at most limit of them.

    index is what record_index() gave. Blocks without such a record are not opened; a block that begins before the first one
    is parsed from its start. One row for each chosen block comes to the driver.
    """
    last = 2**62 if limit is None else first + limit - 1
    chosen = index.where((F.col("n") > 0) & (F.col("first") <= last) & (F.col("first") + F.col("n") > first)).orderBy("file", "start")
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("first"))
    take = F.least(F.col("n") - skip, F.lit(last) + 1 - F.greatest(F.col("first"), F.lit(first)))
    rows = chosen.select("file", "kind", "start", "stop", F.col("first").alias("number"), skip.alias("skip"), take.alias("take")).collect()
    return _source(spark, [tuple(r) for r in rows])


def read_from(spark: SparkSession, file: str, offset: int = 0, block: int = BLOCK) -> DataFrame:
    """Records of one file that start at a byte or behind it; index is null, since what lies before is not read."""
    rows = blocks_of(spark, [file], block).where(F.col("stop") > offset).orderBy("start").collect()
    return _source(spark, [(r["file"], r["kind"], max(r["start"], offset), r["stop"]) for r in rows])


def stream_records(spark: SparkSession, file: str, kind: str, first: int = 0, most: int = 10_000) -> DataFrame:
    """A stream of a growing file's records, from byte first on, at most most of them in one micro-batch.

    The last FASTA record is given once another one begins behind it.
    """
    spark.dataSource.register(SequenceRecords)
    return spark.readStream.format("sequence_records").option("path", file).option("kind", kind).option("first", first).option("most", most).load()
