import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import index, layers
from strandline.operators.layers import LayeredIndex, Policy

ROWS = "feature long, tgt long, win int"


def rows_of(seed, targets, features=60, n=2500):
    rng = random.Random(seed)
    skewed = lambda: min(int(rng.expovariate(0.08)), features - 1)
    return sorted({(skewed(), rng.choice(targets), rng.randrange(50)) for _ in range(n)})


def brute(rows, policy):
    own = {}
    for f, t, w in sorted(rows):
        own.setdefault(f, []).append((f, t, w))
    kept = [x[: policy.most] for x in own.values() if not (policy.remove_overpopulated and len(x) > policy.most - 1)]
    return sorted(r for x in kept for r in x)


def key(df):
    return sorted(tuple(r) for r in df.select("feature", "tgt", "win").collect())


@pytest.fixture(params=[Policy(40), Policy(40, True), Policy(1), Policy(2, True)], ids=str)
def policy(request):
    return request.param


def test_layers_equal_one_index(spark, tmp_path, policy):
    parts = [rows_of(i, range(100 * i, 100 * i + 90), n=800) for i in range(4)]
    store = LayeredIndex.create(spark, f"{tmp_path}/ix", spark.createDataFrame(parts[0], ROWS), policy, 3)
    for i, p in enumerate(parts[1:], 1):
        before = {x["id"] for x in store.layers}
        store = store.append(spark.createDataFrame(p, ROWS), 2)
        assert len(store.layers) == i + 1 and {x["id"] for x in store.layers[:-1]} == before
        want = brute([r for q in parts[: i + 1] for r in q], policy)
        assert key(store.rows(tombstones=False)) == want
    wanted = [0, 3, 7, 59, 12345]
    few = spark.createDataFrame([(x,) for x in wanted], "feature long")
    assert key(store.lookup(few)) == [r for r in want if r[0] in wanted]
    many = spark.range(5, 1000).select(F.col("id").alias("feature"))
    assert key(store.lookup(many)) == [r for r in want if r[0] >= 5]
    assert key(store.lookup(few.limit(0))) == []
    again = LayeredIndex.open(spark, f"{tmp_path}/ix")
    assert (again.version, again.policy) == (4, policy) and key(again.lookup(many)) == key(store.lookup(many))
    one = store.compact(everything=True)
    assert len(one.layers) == 1 and key(one.rows(tombstones=False)) == want
    later = rows_of(9, range(900, 990), n=800)
    assert key(one.append(spark.createDataFrame(later, ROWS)).rows(tombstones=False)) == brute([r for q in [*parts, later] for r in q], policy)
    assert key(LayeredIndex.open(spark, f"{tmp_path}/ix", 1).rows(tombstones=False)) == brute(parts[0], policy)


def test_removed_features_do_not_come_back(spark, tmp_path):
    """A feature that was overpopulated when it was indexed stays away, though the new targets have few of its locations."""
    policy = Policy(10, True)
    old = [(1, t, 0) for t in range(50)] + [(2, 0, 0)]
    store = LayeredIndex.create(spark, f"{tmp_path}/ix", spark.createDataFrame(old, ROWS), policy)
    store = store.append(spark.createDataFrame([(1, 99, 0), (2, 99, 0)], ROWS))
    assert key(store.rows(tombstones=False)) == [(2, 0, 0), (2, 99, 0)]
    assert store.compact(everything=True).layers[0]["rows"] == 3  # the tombstone is kept for layers to come


def test_similar_layers_merge_and_small_ones_leave_large_ones_alone(spark, tmp_path):
    make = lambda i, n: spark.range(n).select(F.col("id").alias("feature"), F.lit(i).cast("long").alias("tgt"), F.lit(0).alias("win"))
    store = LayeredIndex.create(spark, f"{tmp_path}/ix", make(0, 5000), buckets=2)
    written = 5000
    for i in range(1, 13):
        store = store.append(make(i, 10), 1)
        before = {x["id"] for x in store.layers}
        store = store.compact(4)
        written += 10 + sum(x["rows"] for x in store.layers if x["id"] not in before)
        assert store.layers[0]["rows"] == 5000 and len(store.layers) < 8
    assert store.rows().count() == 5120 and written < 5000 + 12 * 10 * 4
    store.vacuum()
    assert key(LayeredIndex.open(spark, f"{tmp_path}/ix").rows()) == key(store.rows())
    with pytest.raises(Exception, match="000000001"):
        LayeredIndex.open(spark, f"{tmp_path}/ix", 1)


def test_one_of_two_writers_wins(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, 1)], ROWS)
    store = LayeredIndex.create(spark, f"{tmp_path}/ix", r)
    store.append(r)
    with pytest.raises(RuntimeError, match="newer version"):
        store.append(r)
    (tmp_path / "ix/_versions/000000003.json").write_text('{"layers": [')
    assert LayeredIndex.open(spark, f"{tmp_path}/ix").version == 2
    with pytest.raises(FileNotFoundError):
        LayeredIndex.open(spark, f"{tmp_path}/nothing")


def _plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan


def scanned_rows(df):
    """Rows that the scans of an executed plan gave."""
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            out += p.metrics().apply("numOutputRows").value()
        todo += [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_the_index_does_not_move_and_few_features_read_little(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select((F.xxhash64("id") % 50_000).alias("feature"), F.col("id").alias("tgt"), F.lit(0).alias("win"))
    store = LayeredIndex.create(spark, f"{tmp_path}/ix", rows, buckets=16)
    wanted = spark.range(5000).select((F.xxhash64("id") % 50_000).alias("feature")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(store.lookup(wanted))
        index_side = plan[plan.index("SortMergeJoin") :].split("Exchange")[0]
        assert "FileScan parquet" in index_side or "Scan parquet" in index_side  # the first child, without an exchange above it
        two = store.append(rows.where("id % 100 = 0").withColumn("tgt", F.col("tgt") + n), 4)
        plan = _plan(two.lookup(wanted))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = store.lookup(wanted.limit(5))
    few.collect()
    many = store.lookup(wanted)
    many.collect()
    assert scanned_rows(many) == n
    assert 0 < scanned_rows(few) <= n * 6 / 16
    assert few.count() == many.join(wanted.limit(5), "feature", "left_semi").count()


def test_settled_rows_equal_the_plain_operators(spark):
    rows = spark.createDataFrame(rows_of(3, range(40)), ROWS)
    assert key(Policy(40).settle(rows)) == key(index.cap_locations(rows, 40))
    assert key(Policy(40, True).settle(rows).where("tgt is not null")) == key(index.remove_overpopulated(rows, 40))
    assert layers.buckets_for(0) == 1 and layers.buckets_for(10**12) == layers.MOST_BUCKETS
