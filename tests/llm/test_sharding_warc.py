import random

import pytest
from pyspark.sql import functions as F
from strandline.llm import sharding, warc


def store(spark, tmp_path, **policy):
    return sharding.ShardStore(spark, f"file://{tmp_path}/store", sharding.Policy(**policy))


def test_append_compact_and_read_back(spark, tmp_path, odd_docs):
    s = store(spark, tmp_path, target_bytes=20_000, smallest_bytes=1500, fanout=3)
    rows = odd_docs.collect()
    for i in range(7):
        s.append(spark.createDataFrame(rows[i::7], odd_docs.schema).coalesce(1))
    before = s.manifest()
    assert before.version == 7 and len(before.shards) == 7
    after = s.compact(final=False)
    assert len(after.shards) < 7
    found = s.read().drop("shard").collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, found)) == sorted(map(key, rows))
    assert sum(x.rows for x in after.shards) == len(rows)


def test_tiers_merge_like_with_like(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=1000, smallest_bytes=10, fanout=4)
    shard = lambda i, n: sharding.Shard(f"f/p{i}", n, 1)
    small, large, full = [shard(i, 10) for i in range(5)], [shard(i, 400) for i in range(5, 8)], [shard(9, 600)]
    runs = s.plan(small + large + full)
    assert [{x.size for x in run} for run in runs] == [{10}, {400}]
    assert all(sum(x.size for x in run) <= 1000 for run in runs)
    assert s.plan([shard(1, 10), shard(2, 10)]) == [] and len(s.plan([shard(1, 10), shard(2, 200)], final=True)) == 1


def test_many_runs_in_one_job_keep_all_rows(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=4000, smallest_bytes=500, fanout=2)
    for i in range(3):
        s.append(spark.range(i * 1000, i * 1000 + 1000).repartition(9))
    s.compact(final=False)
    again = s.compact()
    assert sorted(r.id for r in s.read().collect()) == list(range(3000))
    assert sum(x.rows for x in again.shards) == 3000 and len({x.name for x in again.shards}) == len(again.shards)


def test_a_run_longer_than_a_job_is_merged_in_parts(spark, tmp_path):
    s = store(spark, tmp_path, fanout=2, most_shards=4)
    for i in range(3):
        s.append(spark.range(i * 30, i * 30 + 30).repartition(3))
    assert len(s.manifest().shards) == 9 and [len(x) for x in s.plan(s.manifest().shards)] == [4]
    assert len(s.compact().shards) == 1
    assert sorted(r.id for r in s.read().collect()) == list(range(90))


def test_commit_is_exclusive(spark, tmp_path):
    s = store(spark, tmp_path)
    zero = s.manifest()
    one = s.commit(zero, [sharding.Shard("f/a", 1, 1)])
    with pytest.raises(sharding.CommitConflict):
        s.commit(zero)
    s._versions = lambda: []  # a writer that has not seen version 1
    with pytest.raises(sharding.CommitConflict):
        s.commit(zero)
    del s._versions
    assert s.manifest().shards == one.shards and not [x for x in (tmp_path / "store/manifest").iterdir() if "json" not in x.name]


def test_two_writers_keep_each_others_rows(spark, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    late, write = b._write, b._write

    def between(df):
        new = write(df)
        a.append(spark.range(5).coalesce(1))
        return new

    b._write = between
    b.append(spark.range(5, 9).coalesce(1))
    assert late and sorted(r.id for r in a.read().collect()) == list(range(9))


@pytest.mark.parametrize("step", ["data", "temporary", "torn"])
def test_a_writer_that_dies_blocks_nobody(spark, tmp_path, step):
    """Killed after its data, after the manifest under its temporary name, or with half a version (by other means than commit)."""
    s = store(spark, tmp_path)
    s.append(spark.range(4).coalesce(1))
    dead = store(spark, tmp_path)
    new = dead._write(spark.range(100, 104).coalesce(1))
    if step == "temporary":
        dead._publish_file = lambda a, b: (_ for _ in ()).throw(KeyboardInterrupt())
        with pytest.raises(KeyboardInterrupt):
            dead.commit(dead.manifest(), new)
    if step == "torn":
        (tmp_path / "store/manifest/000000000002.json").write_text('{"version": 2, "sha')
    assert sorted(r.id for r in s.read().collect()) == list(range(4))
    for i in range(2):
        s.append(spark.range(4 + 4 * i, 8 + 4 * i).coalesce(1))
    s.compact()
    assert sorted(r.id for r in s.read().collect()) == list(range(12))
    assert s.vacuum(1, 0) >= 4 and sorted(r.id for r in s.read().collect()) == list(range(12))
    assert len(list((tmp_path / "store/data").rglob("*.parquet"))) == len(s.manifest().shards)


def test_old_versions_stay_readable_until_they_are_forgotten(spark, tmp_path):
    s = store(spark, tmp_path, fanout=2)
    for i in range(23):
        s.append(spark.range(i, i + 1).coalesce(1))
        if i == 12:
            s.compact()
    then = {v: sorted(r.id for r in s.read(s.manifest(v)).collect()) for v in (1, 5, 13, 14, 24)}
    assert then == {1: [0], 5: list(range(5)), 13: list(range(13)), 14: list(range(13)), 24: list(range(23))}
    assert s.vacuum(keep_versions=3, older_than=3600) == 0  # too young
    assert s.vacuum(keep_versions=3, older_than=0) == 13
    assert sorted(r.id for r in s.read(s.manifest(22)).collect()) == list(range(21))
    with pytest.raises(ValueError):
        s.manifest(5)
    with pytest.raises(ValueError):
        s.manifest(99)


def test_empty_tables_clashing_columns_and_unlisted_files(spark, tmp_path, no_docs, odd_docs):
    from odd_tables import with_clashing_columns

    s = store(spark, tmp_path)
    with pytest.raises(ValueError):
        s.read()
    s.append(no_docs)
    s.compact()
    assert s.read().drop("shard").schema.names == no_docs.schema.names and s.read().count() == 0
    with pytest.raises(ValueError):
        s.append(spark.range(3))
    clash = with_clashing_columns(odd_docs).withColumn("file", F.lit(1)).withColumn("run", F.lit(2)).withColumn("of", F.lit(None).cast("map<string,int>"))
    t = sharding.shard_arrivals([clash.coalesce(1), clash.where("false"), clash.coalesce(1)], f"file://{tmp_path}/two", keep_versions=1, older_than=0)
    assert t.read().drop("shard").columns == clash.columns and t.read().count() == 2 * odd_docs.count() and len(t.manifest().shards) == 1
    spark.range(99).write.parquet(f"file://{tmp_path}/two/data/orphan/x")
    assert t.read().count() == 2 * odd_docs.count()


def test_a_run_is_repeatable(spark):
    from strandline.llm import registry

    q = registry.queries()["op2_size_tiered_shards"]
    one, two = (sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert one == two and "Python" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


RECORD = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, digest string"


def brute(rows):
    out = {}
    for r in rows:
        best = None
        if r[3] == 304 and r[1] and r[2] is not None:
            old = [x for x in rows if x[3] == 200 and x[1] == r[1] and x[2] is not None and x[2] < r[2]]
            best = max(old, key=lambda x: (x[2], x[0]), default=None)
        if r[3] == 200:
            out[r[0]] = ("full", r[0])
        elif r[3] != 304:
            out[r[0]] = ("other", None)
        elif best is None:
            out[r[0]] = ("missing", None)
        else:
            tag = lambda t: t.removeprefix("W/")
            same = tag(r[4]) == tag(best[4]) if r[4] and best[4] else r[5] is not None and r[5] == best[5]
            out[r[0]] = ("resolved", best[0]) if same else ("mismatch", None)
    return out


@pytest.mark.parametrize("slot", [1, 7, 1000])
def test_revisits_against_brute_force(spark, slot):
    r = random.Random(slot)
    rows = [(i, r.choice(["h/a", "h/a", "h/a", "h/b", None]), r.choice([None, *range(60)]), r.choice([200, 304, 304, 404, None]), r.choice([None, "x", "W/x", "y"]), r.choice([None, "d1", "d2"]), {"Date": str(i)}, f"g{i}") for i in range(300)]
    found = {x.record_id: (x.outcome, x.resolved_id) for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORD).withColumn("near", F.lit("clash")).withColumn("ref", F.lit(1)), slot).collect()}
    assert found == brute(rows)


def test_headers_merge_and_canonical_urls(spark):
    rows = [
        (1, "HTTP://www.Example.com:80/a/?b=2&utm_source=q&a=1#top", 5, 200, '"t"', None, {"Content-Type": "text/html", "Date": "one", "X": None}, "body"),
        (2, "https://example.com/a?a=1&b=2", 9, 304, 'W/"t"', None, {"content-type": "bad", "date": "two"}, None),
        (3, "https://example.com/a?a=1&b=2", 9, 304, None, None, None, None),
    ]
    found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert found[1].url_key == found[2].url_key == "example.com/a?a=1&b=2"
    assert found[2].headers == {"content-type": "text/html", "date": "two", "x": None} and found[2].digest == "body"
    assert found[3].outcome == "mismatch"
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_header_names_by_case_and_fields_of_one_connection(spark):
    rows = [
        (1, "h/a", 1, 200, '"t"', None, {"Date": "one", "date": "two", "DATE": None, "Connection": "close", "X-A": None, "x-a": None}, "body"),
        (2, "h/a", 2, 304, '"t"', None, {"date": "new", "Date": "newer", "Keep-Alive": "5", "CONNECTION": "keep-alive", "Proxy-Authenticate": "x", "TE": "y"}, None),
        (3, "h/a", 3, 304, '"t"', None, {}, None),
    ]
    found = {r.record_id: r.headers for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert found[1] == {"date": "one, two", "connection": "close", "x-a": None}
    assert found[2] == {"date": "newer, new", "connection": "close", "x-a": None}
    assert found[3] == found[1]
