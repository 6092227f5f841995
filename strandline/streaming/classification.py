"""Classifying a stream of reads against a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify, matching, sketching
from ..operators.layers import LayeredIndex
from ..params import ClassifyParams, SketchParams
from ..storage import discard, shared_dir, stored


def classify_batch(reads: DataFrame, index: DataFrame | LayeredIndex, taxon_of: DataFrame, rank_arrays: DataFrame, p: SketchParams, c: ClassifyParams) -> DataFrame:
    """(query_id, taxid, rank) for one batch of reads; the whole query plan, for batches and tables alike.

    Of a stored index, what the reads' features have is looked up; a plain table is joined as a whole.
    """
    return _classified(reads, sketching.read_features(reads, p), index, taxon_of, rank_arrays, p, c)


def _classified(reads: DataFrame, features: DataFrame, index: DataFrame | LayeredIndex, taxon_of: DataFrame, rank_arrays: DataFrame, p: SketchParams, c: ClassifyParams) -> DataFrame:
    found = index.lookup(features.select("feature").distinct()) if isinstance(index, LayeredIndex) else index
    cand = matching.candidates(reads, features, found, taxon_of, p, c)
    return classify.with_all_reads(classify.classify(cand, rank_arrays, c), reads)


def classify_stream(reads: DataFrame, index: DataFrame | LayeredIndex, taxon_of: DataFrame, rank_arrays: DataFrame, p: SketchParams, c: ClassifyParams, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that classifies each micro-batch of a stream of reads and writes it below out.

    A batch that is run again after a failure overwrites its own folder, so every read is there once.
    """

    def step(batch: DataFrame, number: int) -> None:
        features = stored(sketching.read_features(batch, p), "batch-features")  # read twice: for the lookup and to count hits
        _classified(batch, features, index, taxon_of, rank_arrays, p, c).write.mode("overwrite").parquet(f"{out}/batch={number}")
        discard(features)

    return reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def classify_stream_once(spark: SparkSession, reads: DataFrame, index: DataFrame | LayeredIndex, taxon_of: DataFrame, rank_arrays: DataFrame, p: SketchParams, c: ClassifyParams) -> DataFrame:
    """Writes reads to a folder, streams them from there, and gives the results: (query_id, taxid, rank)."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    reads.repartition(3).write.parquet(f"{base}/reads")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/reads")
    classify_stream(stream, index, taxon_of, rank_arrays, p, c, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("query_id", "taxid", "rank")
