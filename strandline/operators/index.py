"""The feature index: (feature, tgt, win) rows, their caps and filters, and statistics. layers.py stores it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import MAX_LOCATIONS, SketchParams
from ..storage import stored
from . import moments as states
from .sketching import sketch_features


def unique_targets(targets: DataFrame, order: list[str]) -> DataFrame:
    """Targets without empty sequences; of those that share a name the first by order."""
    w = Window.partitionBy("name").orderBy(*order)
    return targets.where("length(dna) > 0").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def build_index(targets: DataFrame, p: SketchParams = SketchParams(), engine: str = "arrow") -> DataFrame:
    """(feature, tgt, win) of all targets (tgt long, dna string)."""
    return sketch_features(targets, "tgt", "dna", p, engine).select("feature", "tgt", "win")


def feature_counts(index: DataFrame) -> DataFrame:
    """(feature, n): locations of each feature."""
    return index.groupBy("feature").agg(F.count("*").alias("n"))


def cap_locations(index: DataFrame, most: int = MAX_LOCATIONS) -> DataFrame:
    """Of each feature the first most locations in (target, window) order; most is at most 254."""
    w = Window.partitionBy("feature").orderBy("tgt", "win")
    return index.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= min(most, MAX_LOCATIONS)).drop("__n")


def _without(index: DataFrame, features: DataFrame) -> DataFrame:
    return index.join(features.select("feature"), "feature", "left_anti")


def remove_overpopulated(index: DataFrame, most: int = MAX_LOCATIONS) -> DataFrame:
    """Without features that have more than most - 1 locations: counts are combined before the shuffle.

    The index is stored first, since two steps read it and it may be the result of sketching all targets.
    """
    index = stored(index, "index")
    return _without(index, feature_counts(index).where(F.col("n") > most - 1))


def remove_ambiguous(index: DataFrame, ancestors: DataFrame, most: int = 1) -> DataFrame:
    """Without features found in more than most taxa; ancestors is (tgt, anc), and a missing one counts as one taxon.

    The index is stored first, as above.
    """
    index = stored(index, "index")
    taxa = index.select("feature", "tgt").distinct().join(ancestors.select("tgt", "anc"), "tgt", "left")
    many = taxa.select("feature", F.coalesce("anc", F.lit(0)).alias("anc")).distinct().groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return _without(index, many)


def moments(df: DataFrame, value: str) -> DataFrame:
    """One row: n, total, max, mean, sample standard deviation, skewness (third central moment over the sample variance to
    the power 1.5) and excess kurtosis."""
    n = F.count(value)
    return df.agg(n.alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), (F.skewness(value) * F.pow((n - 1) / n, F.lit(1.5))).alias("skewness"), F.kurtosis(value).alias("kurtosis"))


def stored_statistics(spark: SparkSession, histogram: dict[int, int]) -> DataFrame:
    """The same as index_statistics() from how many features have how many locations, without the index."""
    rows = spark.createDataFrame([(f, float(n), 0.0, 0.0, 0.0) for n, f in histogram.items()], "n long, mean double, m2 double, m3 double, m4 double")
    d = states.described(states.merged(rows))
    largest = F.lit(max(histogram, default=None)).cast("long")
    return d.select("n", F.round("total").cast("long").alias("total"), largest.alias("largest"), "mean", "stddev", "skewness", F.col("excess").alias("kurtosis"))


def index_statistics(index: DataFrame) -> DataFrame:
    """moments() of the locations per feature."""
    return moments(feature_counts(index), "n")
