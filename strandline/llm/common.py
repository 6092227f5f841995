"""What several corpus operators share: table access, durable intermediates and connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bounded_broadcast, discard, shared_dir, stored

__all__ = ["bounded_broadcast", "discard", "shared_dir", "stored"]
#: Fixed value: a word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most size in this session, so that a worker holds little of a table of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Gives freed memory back: workers wait for further tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def thrifty(run: Callable) -> Callable:
    """run, a generator over Arrow batches, with release() at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, one row to the driver."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def blocks_for(n_bytes: int, block_bytes: int) -> int:
    return max(1, -(-n_bytes // block_bytes))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps, each an aggregate by node with map-side combine and a join; neither
    gathers a node's neighbours in one row, so a hub with many links is an ordinary join key. Rounds grow with the
    logarithm of the longest path. Self-loops, repeated and reversed edges are allowed; an empty table gives no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        last = e
        # large star: every larger neighbour of u is linked to the smallest node of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        star = big.join(low, "u")
        e = stored(star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
