"""Reads per taxon while they arrive: counts are kept in Spark's state store, across batches and restarts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import create_text, delete, names_in, read_small

CLASSIFIED = "query_id long, taxid long, rank int"


def running_counts(classified: DataFrame, arrived: str | None = None, late: str | None = None) -> DataFrame:
    """(taxid, n) of a stream (query_id, taxid, ...): each query id counts once, with the result that came first.

    All ids seen are state, unless arrived names a timestamp column: then an id is remembered for the time late, and rows that
    come later still than that are dropped with the watermark. A null taxid is a group of its own.
    """
    if arrived:
        once = classified.withWatermark(arrived, late or "1 day").dropDuplicatesWithinWatermark(["query_id"])
    else:
        once = classified.dropDuplicates(["query_id"])
    return once.groupBy("taxid").agg(F.count("*").alias("n"))


def abundance_stream(classified: DataFrame, out: str, checkpoint: str, arrived: str | None = None, late: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that writes all counts after each micro-batch, as a version of its own below out.

    A version is published by one small file once it is whole; a batch that is run again after a failure gives the same
    counts from the same state and writes them anew. The last two versions stay, so that a reader can finish.
    """

    def publish(counts: DataFrame, number: int) -> None:
        spark = counts.sparkSession
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        delete(spark, f"{out}/_published/{number:012d}.json")
        create_text(spark, f"{out}/_published/{number:012d}.json", json.dumps({"batch": number}))
        for old in names_in(spark, f"{out}/_published")[:-2]:
            delete(spark, f"{out}/_published/{old}")
            delete(spark, f"{out}/counts/batch={int(old.split('.')[0])}")

    counts = running_counts(classified, arrived, late)
    return counts.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """(taxid, n, percent) as last published; no rows before the first batch."""
    published = [n for n in names_in(spark, f"{out}/_published") if n.endswith(".json") and not n.startswith(".")]
    if not published:
        return spark.createDataFrame([], "taxid long, n long, percent double")
    last = json.loads(read_small(spark, f"{out}/_published/{published[-1]}"))["batch"]
    counts = spark.read.schema("taxid long, n long").parquet(f"{out}/counts/batch={last}")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("taxid", "n", (100 * F.col("n") / F.col("total")).alias("percent"))  # total is one row
