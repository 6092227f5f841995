import random

import pytest
from pyspark.sql import functions as F
from strandline.sources import records, sequences
from strandline.storage import stored


def fasta(n, seed=1, end="\n"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 200)))
        out.append(f">r{i} >x é{end}" + end.join(seq[j : j + 60] for j in range(0, len(seq), 60)) + end)
    return "".join(out)


def fastq(n, seed=1):
    """Qualities that begin with the signs of headers, and headers that hold them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        out.append(f"@r{i} @+\n{seq}\n+{rng.choice(['', f'r{i}'])}\n{rng.choice('@+>I')}{'I' * (len(seq) - 1)}\n")
    return "".join(out)


@pytest.fixture
def files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.fa").write_text(fasta(40))
    (d / "b.fasta").write_text(fasta(25, 2, "\r\n"))
    (d / "c.fq").write_text(fastq(60))
    (d / "d.fastq").write_text(fastq(3, 4).rstrip("\n"))
    (d / "e.fa").write_text("")
    return d


def key(df):
    name = F.substring_index("file", "/", -1)
    return sorted(tuple(r) for r in df.select(name, "index", "header", "data", "qualities").collect())


@pytest.mark.parametrize("block", [1, 7, 64, 1000, records.BLOCK])
def test_cut_at_any_byte(files, block):
    """Blocks of any size give the records that one block gives, each once, wherever a file is cut."""
    for name in ("a.fa", "b.fasta", "c.fq", "d.fastq"):
        path = f"{files}/{name}"
        size, kind = (files / name).stat().st_size, sequences.format_of(path)
        whole = list(records.records(records.Block(path, kind, 0, size)))
        step = max(block, size // 400)  # all small steps of a small part, larger ones of the whole
        cut = [r for lo in range(0, size, step) for r in records.records(records.Block(path, kind, lo, min(size, lo + step)))]
        assert cut == whole
        raw = (files / name).read_bytes()
        assert all(raw[r[0] : r[0] + 1] == (b">" if kind == "fasta" else b"@") for r in whole)


def test_equal_to_the_readers_of_whole_files(spark, files):
    ix = records.record_index(spark, [str(files)], 500)
    assert ix.count() > 10
    assert key(records.read_records(spark, ix)) == key(sequences.read_sequences(spark, str(files)))


def test_a_first_record_and_a_limit_open_their_blocks_alone(spark, files):
    ix = stored(records.record_index(spark, [str(files)], 300), "records")
    whole = key(sequences.read_sequences(spark, str(files)))
    for first, limit in ((1, 5), (17, None), (38, 4), (61, 3), (2, 0)):
        got = records.read_records(spark, ix, first, limit)
        assert key(got) == [r for r in whole if first <= r[1] and (limit is None or r[1] < first + limit)]
    assert records.read_records(spark, ix, 38, 2).rdd.getNumPartitions() <= 4 < ix.count()


def test_seek_and_tell(spark, files):
    path = f"{files}/c.fq"
    rows = records.read_records(spark, records.record_index(spark, [path], 200)).orderBy("index").collect()
    at = rows[30].offset
    again = records.read_from(spark, path, at, 200).orderBy("offset").collect()
    assert [r.header for r in again] == [r.header for r in rows[30:]]
    assert [r.header for r in records.read_from(spark, path, at + 1).orderBy("offset").collect()] == [r.header for r in rows[31:]]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    path, out = tmp_path / "grow.fq", f"{tmp_path}/out"

    def run():
        q = records.stream_records(spark, str(path), "fastq", most=7).select("offset", "header").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return [r.header for r in spark.read.parquet(out).orderBy("offset").collect()]

    text = fastq(30)
    lines = text.splitlines(keepends=True)
    path.write_text("".join(lines[:42]) + "AC")  # ten records and a part of one
    assert run() == [f"r{i} @+" for i in range(10)]
    path.write_text(text)
    assert run() == [f"r{i} @+" for i in range(30)]


@pytest.mark.parametrize(("name", "text", "message"), [("x.fa", "ACGT\n>a\nAC\n", "no '>'"), ("x.fa", ">a\n>b\nAC\n", "without letters"), ("x.fq", "@a\nAC\nII\n@b\n", "not a FASTQ"), ("x.fq", "@a\nAC\n+\n", "not a FASTQ")])
def test_bad_files_raise(spark, tmp_path, name, text, message):
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match=message):
        records.read_from(spark, f"{tmp_path}/{name}").collect()


def test_blank_line_ends_fastq_and_one_long_record(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n\n@b\nAC\n+\nII\n")
    assert [r.header for r in records.read_from(spark, f"{tmp_path}/x.fq").collect()] == ["a"]
    (tmp_path / "y.fa").write_text(">long\n" + "ACGT" * 1_000_000 + "\n>b\nA")
    ix = records.record_index(spark, [f"{tmp_path}/y.fa"], 100_000)
    assert [(r["index"], len(r.data)) for r in records.read_records(spark, ix).orderBy("index").collect()] == [(1, 4_000_000), (2, 1)]
