import pytest
from pyspark.sql import functions as F
from strandline.operators.layers import LayeredIndex
from strandline.params import ClassifyParams
from strandline.plans import fixtures as fx
from strandline.plans import queries as q
from strandline.streaming import abundance, classification

SF = "/root/testdata/sf0.001"


def counts(spark, out):
    return {r.taxid: r.n for r in abundance.latest_counts(spark, out).collect()}


def test_counts_go_on_after_a_restart_and_count_each_query_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, abundance.CLASSIFIED)
    start = lambda: abundance.abundance_stream(spark.readStream.schema(abundance.CLASSIFIED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert counts(spark, f"{tmp_path}/out") == {}
    rows((1, 7, 4), (2, 7, 4), (3, None, None)).coalesce(1).write.parquet(f"{tmp_path}/in")
    start()
    assert counts(spark, f"{tmp_path}/out") == {7: 2, None: 1}
    rows((2, 9, 4), (4, 9, 4), (4, 9, 4)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows((5, 7, 4), (1, 9, 4)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start()
    assert counts(spark, f"{tmp_path}/out") == {7: 3, 9: 1, None: 1}
    assert abundance.latest_counts(spark, f"{tmp_path}/out").agg(F.sum("percent")).first()[0] == pytest.approx(100)
    start()  # nothing new
    assert counts(spark, f"{tmp_path}/out") == {7: 3, 9: 1, None: 1}


def test_a_batch_that_runs_again_publishes_the_same(spark, tmp_path):
    schema = abundance.CLASSIFIED
    spark.createDataFrame([(1, 7, 4), (2, 8, 4)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: abundance.abundance_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    (tmp_path / "cp/commits/0").unlink()  # as if the driver had died before the batch was committed
    (tmp_path / "cp/commits/.0.crc").unlink(missing_ok=True)
    run()
    assert counts(spark, f"{tmp_path}/out") == {7: 1, 8: 1}


def test_ids_are_forgotten_with_the_watermark(spark, tmp_path):
    schema = "query_id long, taxid long, at timestamp"
    rows = lambda *x: spark.createDataFrame(x, "query_id long, taxid long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: abundance.abundance_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", "at", "10 minutes").awaitTermination()
    rows((1, 7, "2024-01-01 00:00:00"), (1, 7, "2024-01-01 00:05:00"))
    run()
    rows((1, 7, "2024-01-01 00:06:00"), (2, 7, "2024-01-01 02:00:00"))
    run()
    assert counts(spark, f"{tmp_path}/out") == {7: 2}


def test_stream_against_a_stored_index(spark):
    """Micro-batches look features up in the layers; the index is neither built again nor moved."""
    store = LayeredIndex.create(spark, q._place(spark, "ix"), q._index(spark, SF))
    reads = fx.reads(spark, SF)
    arrays = q.taxonomy.ranked_arrays(q._lineages(spark, SF))
    c = ClassifyParams().resolved()
    key = lambda df: sorted(map(repr, df.select("query_id", "taxid", "rank").collect()))
    plain = classification.classify_batch(reads, q._capped(spark, SF), q._taxon_of(spark, SF, 0), arrays, fx.CLASSIFY, c)
    streamed = classification.classify_stream_once(spark, reads, store, q._taxon_of(spark, SF, 0), arrays, fx.CLASSIFY, c)
    assert key(plain) == key(streamed)
