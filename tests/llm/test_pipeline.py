import re

import corpus_pipeline
from odd_tables import with_clashing_columns
from pyspark.sql import functions as F
from test_suffix import brute as brute_cut
from test_text_operators import brute_components, brute_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            assert set(before) >= set(kept[name]) and len(kept[name]) > 0.7 * len(before)
            assert len(toxic & {r.doc_id for r in kept[name]}) <= len(toxic) / 2
        if name == "quality":
            failed = lambda t: (lambda c: c[0] < 20 or 100 * c[4] > 30 * c[0])(brute_quality(t))
            assert set(before) >= set(kept[name])
            assert not any(failed(r.text) for r in kept[name])
        if name == "near_dedup":
            import test_text_operators as t

            old, t.brute_shingles.__defaults__ = t.brute_shingles.__defaults__, (5,)
            want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in before]).items() if i == c}
            t.brute_shingles.__defaults__ = old
            assert {r.doc_id for r in kept[name]} == want
        if name == "suffix_dedup":
            want = {r.doc_id: b[1] for r, b in zip(before, brute_cut([r.text for r in before]))}
            text = {r.doc_id: r.text for r in before}
            for r in kept[name]:
                assert len(text[r.doc_id].encode()) - len(r.text.encode()) - want[r.doc_id] in (0, 1, 2, 3)
                assert r.n_chars == len(r.text)
        if name != "packing":
            assert docs.columns == columns
    assert sum(r.length for r in kept["packing"]) == sum(r.doc_tokens for r in {(r.doc_id): r for r in kept["packing"]}.values())
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["suffix_dedup"]}


def test_repeated_rows_leave_one_whole_text(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, kept.collect())) == sorted(map(key, rows[2:]))
    cut = corpus_pipeline.cut_passages(spark, kept, SF)
    assert sorted(map(key, cut.collect())) == sorted(map(key, rows[2:]))


def test_run_equals_its_stages(spark):
    """The rows of run() are those of its stages one after the other, and every piece's checksum is that of its document's ids."""
    import struct
    import zlib

    from strandline.llm.bpe import bpe, default_vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF), name)
    text = {r.doc_id: r.text for r in docs.collect()}
    piece = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    found = corpus_pipeline.run(spark, SF).collect()
    # cuts depend on what shares a task with what, pieces together do not
    whole = lambda rows: {(i, n) for i, _, _, _, n in piece(rows)}
    assert whole(found) == whole(corpus_pipeline.pack(spark, docs, SF).collect()) and {i for i, _ in whole(found)} == set(text)
    coder, at = bpe(default_vocabulary()), {}
    for i, start, length, crc, n in piece(found):
        ids = [*coder.whole(text[i]).tolist(), 0]
        assert start == at.get(i, 0) and n == len(ids) and crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
        at[i] = start + length
        if start + length == n:
            at[i] = n
    assert at == {i: n for i, n in whole(found)}
    assert [bool(re.fullmatch(r"\w+", n)) for n, _ in corpus_pipeline.STAGES] == [True] * 5


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (no_docs, odd_docs.withColumn("cluster", F.lit("clash")), with_clashing_columns(odd_docs).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns
