"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

Arrivals are appended as small Parquet shards, one for each writing task. Shards of similar size (one tier) are merged
into larger ones until they reach the target. Readers see what a manifest version lists, and only that: a job that dies
leaves files that no version names.

A version is one small file of what it adds and removes; every CHECKPOINT-th lists all shards, so that reading replays few
files. It is written under a name of its own first and then published by an operation that fails if the version is there
already, so that a version is whole or not there, and of two writers one has to retry. Old versions stay readable until
vacuum() forgets them and deletes what no kept version names. The driver holds one record of about 100 bytes for each shard:
100 TB in shards of 128 MB are 800 000.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Every so many versions one lists all shards.
CHECKPOINT = 10
_END = "\nend\n"


@dataclass(frozen=True)
class Policy:
    """Production parameters. most_shards: how many shards one merge job takes at most; the rest follow in the next job."""

    target_bytes: int = 128 << 20
    fanout: int = 4
    smallest_bytes: int = 1 << 20
    most_shards: int = 10_000

    def tier(self, size: int) -> int:
        """0 up to smallest_bytes, then one more for each factor of fanout."""
        return max(0, math.ceil(math.log(max(size, 1) / self.smallest_bytes, self.fanout)))

    def full(self, size: int) -> bool:
        return 2 * size > self.target_bytes


@dataclass(frozen=True)
class Shard:
    """name: its path below the store's data folder; of: how many shards were written to that folder."""

    name: str
    size: int
    rows: int
    of: int = 1

    @property
    def folder(self) -> str:
        return self.name.rsplit("/", 1)[0]


def shard_name(path: Column) -> Column:
    return F.substring_index(path, "/data/", -1)


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


@dataclass
class Manifest:
    version: int
    shards: list[Shard] = field(default_factory=list)
    schema: StructType | None = None


class CommitConflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    """A table of shards in a folder that all executors share.

    publish(temporary, final) makes a file appear under its final name, and raises FileExistsError if that is there: by default
    a hard link on a local file system, else a rename that does not overwrite. Stores without such a rename need one of their own.
    """

    def __init__(self, spark: SparkSession, root: str, policy: Policy = Policy(), publish: Callable[[str, str], None] | None = None):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._publish_file = publish or self._default_publish

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _default_publish(self, temporary: str, final: str) -> None:
        try:
            if self._fs.getUri().getScheme() == "file":
                nio, file = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
                nio.createLink(file(final), file(temporary))
                self._fs.delete(self._path(temporary), False)
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(self._path(temporary), self._path(final), options)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(final) from e
            raise

    def _versions(self) -> list[int]:
        """Numbers of all version files, whole or not."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _version_path(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def _load(self, version: int) -> dict | None:
        """What a version file says; None if it is not whole (no file that was published by commit())."""
        stream = self._fs.open(self._path(self._version_path(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text[: -len(_END)]) if text.endswith(_END) else None

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version or a given one; version 0 has no shards. ValueError if the given one is unknown or forgotten."""
        there = [v for v in self._versions() if version is None or v <= version]
        changes = []
        for v in reversed(there):
            c = self._load(v)
            if c is not None:
                changes.append(c)
                if c["checkpoint"]:
                    break
        if version and (not changes or changes[0]["version"] != version):
            raise ValueError(f"{self.root} has no version {version}")
        if not changes:
            return Manifest(0)
        held: dict[str, Shard] = {}
        for c in reversed(changes):
            for name in c["remove"]:
                del held[name]
            held |= {s["name"]: Shard(**s) for s in c["add"]}
        schema = changes[0]["schema"]
        return Manifest(changes[0]["version"], sorted(held.values(), key=lambda s: s.name), StructType.fromJson(schema) if schema else None)

    def commit(self, before: Manifest, add: list[Shard] = (), remove: list[Shard] = (), schema: StructType | None = None) -> Manifest:
        """Publishes before with shards added and removed as the next version; CommitConflict if there is a newer one than before."""
        numbers = self._versions()
        after = max([0, *numbers])
        if any(v > before.version and self._load(v) is not None for v in numbers):
            raise CommitConflict(after)
        gone = {s.name for s in remove}
        new = Manifest(after + 1, sorted([*(s for s in before.shards if s.name not in gone), *add], key=lambda s: s.name), schema or before.schema)
        whole = new.version % CHECKPOINT == 0 or not before.version or new.version > before.version + 1
        body = {"version": new.version, "checkpoint": whole, "add": [asdict(s) for s in (new.shards if whole else add)], "remove": [] if whole else sorted(gone), "schema": new.schema.jsonValue() if new.schema else None}
        temporary = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(temporary), False)
        try:
            stream.write(bytearray((json.dumps(body) + _END).encode()))
        finally:
            stream.close()
        try:
            self._publish_file(temporary, self._version_path(new.version))
        except FileExistsError as e:
            self._fs.delete(self._path(temporary), False)
            raise CommitConflict(new.version) from e
        return new

    def _listed(self, folder: str) -> DataFrame:
        """(name, size, changed): the shards' files below a folder; a distributed listing."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        return files.select(shard_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))

    def _write(self, df: DataFrame) -> list[Shard]:
        """df as one file for each task that has rows; the rows of each file are counted as they are stored."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        rows = self.spark.read.schema(df.schema).parquet(folder).groupBy(shard_name(F.col("_metadata.file_path")).alias("name")).agg(F.count("*").alias("rows"))
        found = self._listed(folder).join(rows, "name").select("name", "size", "rows").collect()  # a record for each new shard
        return [Shard(r["name"], r["size"], r["rows"], len(found)) for r in found]

    def append(self, df: DataFrame, tries: int = 5) -> Manifest:
        """Adds df's rows as new shards, one for each task that has rows. ValueError if df has other columns than the store."""
        held = self.manifest().schema
        kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
        if held is not None and kinds(held) != kinds(df.schema):
            raise ValueError(f"{self.root} holds {kinds(held)}, not {kinds(df.schema)}")
        new = self._write(df)
        return self._retried(lambda now: self.commit(now, new, schema=now.schema or df.schema), tries)

    def _retried(self, commit: Callable[[Manifest], Manifest], tries: int) -> Manifest:
        for i in range(tries):
            try:
                return commit(self.manifest())
            except CommitConflict:
                if i == tries - 1:
                    raise
        raise AssertionError

    def plan(self, shards: list[Shard], final: bool = False) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, each run at least fanout of them and about a target at most.

        final also merges what is left of all tiers below the target, two shards or more.
        """
        runs, by_tier = [], {}
        for s in sorted(shards, key=lambda s: (s.size, s.name)):
            if not self.policy.full(s.size):
                by_tier.setdefault(-1 if final else self.policy.tier(s.size), []).append(s)
        for own in by_tier.values():
            run: list[Shard] = []
            size = 0
            for s in own:
                if run and size + s.size > self.policy.target_bytes:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.size
            runs.append(run)
        # a run that no job could take whole is taken in parts
        runs = [run[i : i + self.policy.most_shards] for run in runs for i in range(0, len(run), self.policy.most_shards)]
        least = 2 if final else self.policy.fanout
        picked, n = [], 0
        for run in runs:
            if (len(run) >= least or len(run) > 1 and self.policy.full(sum(s.size for s in run))) and n + len(run) <= self.policy.most_shards:
                picked.append(run)
                n += len(run)
        return picked

    def compact(self, final: bool = True, tries: int = 5) -> Manifest:
        """Merges tier by tier until nothing is to be merged. Each round is one job and one commit; nothing is deleted.

        What is sent to all tasks of a round is a row for each merged shard, most_shards at most.
        """
        while True:
            now = self.manifest()
            runs = self.plan(now.shards) or (self.plan(now.shards, final=True) if final else [])
            if not runs:
                return now
            merged = [s for run in runs for s in run]
            file, run = (_unused(c, now.schema.names) for c in ("file", "run"))
            place = self.spark.createDataFrame([(s.name, i) for i, own in enumerate(runs) for s in own], f"{file} string, {run} int")
            df = self._read(now, merged).withColumn(file, shard_name(F.col("_metadata.file_path"))).join(F.broadcast(place), file)
            new = self._write(df.repartitionById(len(runs), F.col(run)).select(*(F.col(f"`{c}`") for c in now.schema.names)))
            if sum(s.rows for s in new) != sum(s.rows for s in merged):
                raise RuntimeError("a merge did not keep all rows")
            gone = {s.name for s in merged}

            def replace(held: Manifest) -> Manifest:
                if not gone <= {s.name for s in held.shards}:
                    raise RuntimeError("merged shards are no longer listed")
                return self.commit(held, new, merged)

            self._retried(replace, tries)

    def _read(self, m: Manifest, shards: list[Shard]) -> DataFrame:
        """Some of a version's shards; a folder of which all are wanted is read as one path."""
        count = Counter(s.folder for s in shards)
        whole = {s.folder for s in shards if count[s.folder] == s.of}
        paths = [*(f"{self.root}/data/{f}" for f in sorted(whole)), *(f"{self.root}/data/{s.name}" for s in shards if s.folder not in whole)]
        schema = StructType.fromJson(m.schema.jsonValue())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """The rows of a version (the newest), with the name of each row's shard in shard (instead of a column of that name).

        A store whose tables were all empty gives no rows of their columns; ValueError if nothing was ever appended.
        """
        m = manifest or self.manifest()
        if m.schema is None:
            raise ValueError("nothing was appended to the store")
        df = self._read(m, m.shards)
        return df.withColumn("shard", shard_name(F.col("_metadata.file_path")) if m.shards else F.lit(None).cast("string"))

    def vacuum(self, keep_versions: int = 10, older_than: float = 7 * 86_400) -> int:
        """Forgets all but the newest versions, and deletes files of over older_than seconds that none of the kept ones names.

        Files of jobs that died go as well. Readers of forgotten versions fail. Gives the number of deleted shards.
        """
        numbers = [v for v in self._versions() if self._load(v) is not None]
        kept = numbers[-keep_versions:]
        if not kept:
            return 0
        first = max((v for v in numbers if v <= kept[0] and self._load(v)["checkpoint"]), default=kept[0])
        named = {s.name for v in kept for s in self.manifest(v).shards}
        limit = time.time() - older_than
        if self._fs.exists(self._path(f"{self.root}/data")):
            old = self._listed(f"{self.root}/data").where(F.col("changed") <= F.timestamp_seconds(F.lit(limit)))
            gone = [r["name"] for r in old.select("name").toLocalIterator() if r["name"] not in named]
        else:
            gone = []
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), False)
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            name = s.getPath().getName().lstrip(".")
            left = name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) < first
            if left or not name.endswith(".json") and not name.endswith(".crc") and s.getModificationTime() / 1000 <= limit:
                self._fs.delete(s.getPath(), False)
        return len(gone)


def shard_arrivals(arrivals: list[DataFrame], root: str, policy: Policy = Policy(), keep_versions: int = 10, older_than: float = 7 * 86_400) -> ShardStore:
    """Appends each arrival to the store at root, merging tiers as they fill, and merges what is left at the end.

    Nulls, repeated rows and all columns are kept as they are; empty arrivals add no shard; all empty: a store without rows.
    """
    store = None
    for df in arrivals:
        store = store or ShardStore(df.sparkSession, root, policy)
        store.append(df)
        store.compact(final=False)
        store.vacuum(keep_versions, older_than)
    store.compact()
    store.vacuum(keep_versions, older_than)
    return store


#: How many arrivals op2's query deals its table into.
ARRIVALS = 4


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all documents as ARRIVALS batches and reads them back: doc_id and the MD5 of each stored text, the rows that the
    manifest counts, and whether at most one shard is below half the target."""
    docs = common.table(spark, sf_dir, "documents")
    parts = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == i) for i in range(ARRIVALS)]  # all rows, each in one arrival
    store = shard_arrivals(parts, f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}", keep_versions=1, older_than=0)
    m = store.manifest()
    small = sum(not store.policy.full(s.size) for s in m.shards)
    return store.read(m).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.lit(sum(s.rows for s in m.shards)).cast("long").alias("stored_rows"), F.lit(small <= 1).alias("compacted"))


OP2_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, (SELECT count(*) FROM documents)::bigint AS stored_rows, true AS compacted FROM documents"
