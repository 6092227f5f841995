"""The feature index as stored layers: probed where it lies, and extended without being rewritten.

A layer is a table of (feature, tgt, win), bucketed by feature and sorted inside its buckets, with a Bloom filter of features
in every row group. It holds of each feature the first locations only, or, where overpopulated features are removed, one row
without a target for such a feature: a tombstone, which outlives later layers. The rows that count are made when layers are
read: of each feature the first locations over all layers, and none once a layer has its tombstone or all layers together
have too many. That is what one index of all targets has, however the targets came in.

Versions are small files, created exclusively, which name their layers; layers never change. Readers keep the version they
opened. Merging layers of similar size keeps their number logarithmic.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import MAX_LOCATIONS, SketchParams
from ..storage import create_text, delete, names_in, read_small

SCHEMA = "feature bigint, tgt bigint, win int"
#: Rows that one bucket is meant to hold, and most buckets of a layer.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 4096
#: Up to so many features are looked up one by one: buckets, row groups and pages without them are not read.
POINTS = 256


@dataclass(frozen=True)
class Policy:
    """most: locations of a feature that count; remove_overpopulated: features with most or more locations do not count at all."""

    most: int = MAX_LOCATIONS
    remove_overpopulated: bool = False

    def settle(self, rows: DataFrame) -> DataFrame:
        """Rows as a layer holds them, of any rows and tombstones; one shuffle by feature, none if they are dealt so already."""
        own = Window.partitionBy("feature")
        first = rows.withColumn("__n", F.row_number().over(own.orderBy(F.asc_nulls_first("tgt"), "win"))).where(F.col("__n") <= min(self.most, MAX_LOCATIONS))
        if not self.remove_overpopulated:
            return first.where("tgt is not null").drop("__n")
        # a tombstone is the first row of its feature, and of too many locations the last one that is left has the number most
        dead = F.max(F.col("tgt").isNull() | (F.col("__n") >= min(self.most, MAX_LOCATIONS))).over(own)
        first = first.withColumn("__dead", dead).where(~F.col("__dead") | (F.col("__n") == 1))
        alive = lambda c: F.when(~F.col("__dead"), F.col(c)).alias(c)
        return first.select("feature", alive("tgt"), alive("win"))


def buckets_for(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def bucket_number(letters: int, p: SketchParams) -> int:
    """Buckets for the features of so many letters: a window has at most p.size of them."""
    return buckets_for((letters or 0) // p.stride * p.size)


@dataclass(frozen=True)
class LayeredIndex:
    """One version of a stored index. extra: what belongs to the version besides, as JSON. counts: of the first layers, how
    many features have how many locations; see histogram()."""

    spark: SparkSession = field(repr=False)
    path: str
    version: int
    layers: list[dict]
    policy: Policy
    extra: dict
    counts: dict | None = None

    @staticmethod
    def create(spark: SparkSession, path: str, rows: DataFrame, policy: Policy = Policy(), buckets: int | None = None, extra: dict | None = None) -> LayeredIndex:
        """An index of one layer at path. What lies there already stays readable as earlier versions."""
        before = _versions(spark, path)
        new = LayeredIndex(spark, path, before[-1] if before else 0, [], policy, extra or {})
        new = replace(new, layers=[new._write(rows, buckets)])
        return new._commit(new.layers, new.extra, new._counted())

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> LayeredIndex:
        """The last version, or the one asked for; FileNotFoundError if there is none. A version half written does not count."""
        for v in reversed(_versions(spark, path)) if version is None else [version]:
            try:
                d = json.loads(read_small(spark, f"{path}/_versions/{v:09d}.json"))
            except ValueError:
                continue
            return LayeredIndex(spark, path, v, d["layers"], Policy(**d["policy"]), d["extra"], d.get("counts"))
        raise FileNotFoundError(f"{path} holds no index")

    def _commit(self, layers: list[dict], extra: dict, counts: dict | None = None) -> LayeredIndex:
        version, counts = self.version + 1, counts or self.counts
        try:
            create_text(self.spark, f"{self.path}/_versions/{version:09d}.json", json.dumps({"layers": layers, "policy": asdict(self.policy), "extra": extra, "counts": counts}))
        except FileExistsError:
            raise RuntimeError(f"{self.path} has a newer version than {self.version}: open it again") from None
        return LayeredIndex(self.spark, self.path, version, layers, self.policy, extra, counts)

    def _counted(self) -> dict:
        """histogram() as a version's file has it, with the layers it is of."""
        return {"layers": [x["id"] for x in self.layers], "features": {str(n): f for n, f in self.histogram().items()}}

    def histogram(self) -> dict[int, int]:
        """How many features have how many locations that count: at most MAX_LOCATIONS numbers, stored with the versions.

        Right after create() and compact() it is read from the version's file. Layers that came in since change it by their own
        features alone: what these had before is taken back, what they have now is added.
        """
        ids = [x["id"] for x in self.layers]
        known = self.counts if self.counts and self.counts["layers"] == ids[: len(self.counts["layers"])] else {"layers": [], "features": {}}
        out = {int(n): f for n, f in known["features"].items()}
        new = self.layers[len(known["layers"]) :]
        if not new:
            return out
        if not known["layers"]:
            return _histogram(self.rows(tombstones=False))
        touched = reduce(DataFrame.unionByName, [self._table(x).select(F.expr("feature | 0L").alias("feature")) for x in new]).distinct()
        for sign, rows in ((-1, replace(self, layers=self.layers[: len(known["layers"])]).lookup(touched)), (1, self.lookup(touched))):
            for n, f in _histogram(rows).items():
                out[n] = out.get(n, 0) + sign * f
        return {n: f for n, f in sorted(out.items()) if f}

    def _table(self, layer: dict) -> DataFrame:
        """A layer as a table of the session's catalog, which is how Spark learns about its buckets."""
        name = f"strandline_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{layer['id']}"
        if not self.spark.catalog.tableExists(name):
            where = f"{self.path}/layers/{layer['id']}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (feature) SORTED BY (feature, tgt, win) INTO {layer['buckets']} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, buckets: int | None) -> dict:
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        layer = {"id": uuid.uuid4().hex, "buckets": buckets}
        name = f"strandline_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{layer['id']}"
        dealt = rows.select(F.col("feature").cast("long"), F.col("tgt").cast("long"), F.col("win").cast("int")).repartition(buckets, "feature")
        w = self.policy.settle(dealt).write.bucketBy(buckets, "feature").sortBy("feature", "tgt", "win").format("parquet")
        w = w.option("path", f"{self.path}/layers/{layer['id']}").option("parquet.bloom.filter.enabled#feature", "true").option("parquet.page.row.count.limit", "4096").option("parquet.block.size", str(32 << 20))
        w.saveAsTable(name)
        return layer | {"rows": self._table(layer).count()}

    def append(self, rows: DataFrame, buckets: int | None = None, extra: dict | None = None) -> LayeredIndex:
        """The next version, with one more layer of rows (feature, tgt, win); nothing else is written or read.

        RuntimeError if another writer has made that version: targets numbered on top of this one would not fit it.
        """
        return self._commit([*self.layers, self._write(rows, buckets)], self.extra if extra is None else extra)

    def annotate(self, extra: dict) -> LayeredIndex:
        """The next version, with the same layers and another extra."""
        return self._commit(self.layers, extra)

    def rows(self, layers: list[dict] | None = None, tombstones: bool = True) -> DataFrame:
        """All rows that count, of some layers or all; with or without the tombstones."""
        r = self._settled([self._table(x) for x in (self.layers if layers is None else layers)])
        return r if tombstones else r.where("tgt is not null")

    def _settled(self, parts: list[DataFrame]) -> DataFrame:
        """Rows that count of several layers' rows, which are dealt out by feature for it.

        A union of bucketed tables claims their buckets, though its scans are then made without them; a feature that is an
        expression carries no such claim.
        """
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        if len(parts) == 1:
            return parts[0]
        return self.policy.settle(reduce(DataFrame.unionByName, [p.select(F.expr("feature | 0L").alias("feature"), "tgt", "win") for p in parts]))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """(feature, tgt, win) of the features in wanted (feature, distinct).

        A few features are sought in their buckets alone. More are joined with each layer as it lies: what moves is wanted
        and, with several layers, the rows that were found; never the index.
        """
        few = [r["feature"] for r in wanted.select("feature").limit(POINTS + 1).collect()]  # a bounded number of rows
        few = few if len(few) <= POINTS else None
        found = []
        for layer in self.layers:
            t = self._table(layer)
            if few is None:
                t = t.join(wanted.select("feature"), "feature", "left_semi")
            else:
                t = t.where(_any_of("feature", few) if few else F.lit(False))
            found.append(t)
        return self._settled(found).where("tgt is not null")

    def compact(self, fan_out: int = 4, everything: bool = False) -> LayeredIndex:
        """Merges the last layers into one, as many as are not over fan_out times larger than those behind them together.

        Nothing is done until fan_out layers have come together, so that a row is rewritten a logarithmic number of times.
        Neighbours alone are merged; the result has the same rows.
        """
        tail = len(self.layers) - 1
        while tail > 0 and (everything or self.layers[tail - 1]["rows"] <= fan_out * sum(x["rows"] for x in self.layers[tail:])):
            tail -= 1
        chosen = self.layers[max(tail, 0) :]
        if len(chosen) < (2 if everything else fan_out):
            return self
        buckets = max(max(x["buckets"] for x in chosen), buckets_for(sum(x["rows"] for x in chosen)))
        merged = self._write(self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/layers/{x['id']}" for x in chosen)), buckets)
        layers = [*self.layers[:tail], merged]
        # rows that count are the same, and so are their numbers
        return self._commit(layers, self.extra, replace(self, layers=layers, counts={"layers": [x["id"] for x in layers], "features": self.histogram()})._counted())

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last keep versions, and layers that none of those names. No writer may be at work."""
        versions = _versions(self.spark, self.path)
        kept = {x["id"] for v in versions[-keep:] for x in LayeredIndex.open(self.spark, self.path, v).layers}
        for v in versions[:-keep]:
            delete(self.spark, f"{self.path}/_versions/{v:09d}.json")
        for name in names_in(self.spark, f"{self.path}/layers"):
            if name not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS strandline_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{name}")
                delete(self.spark, f"{self.path}/layers/{name}")


def _histogram(rows: DataFrame) -> dict[int, int]:
    """At most MAX_LOCATIONS rows come to the driver."""
    sizes = rows.groupBy("feature").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("features"))
    return {r["n"]: r["features"] for r in sizes.orderBy("n").collect()}


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split(".")[0]) for n in names_in(spark, f"{path}/_versions") if n.endswith(".json") and not n.startswith(".")]


def _any_of(column: str, values: list):
    """column = v1 OR column = v2 ..., as a flat tree: each equality reaches the files' statistics and Bloom filters."""
    terms = [F.col(column) == F.lit(v) for v in values]
    while len(terms) > 1:
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]
