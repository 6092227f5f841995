"""From sequences to (window, feature) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, features
from ..params import SketchParams

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i
#: Windows that are sorted together, and windows of one sequence that a worker is given at once.
_ROWS, PART_WINDOWS = 4096, 8192
#: Letters of sequences that are sketched together.
_LETTERS = 1 << 18


def sequence_windows(df: DataFrame, key: str, seq: str, p: SketchParams) -> DataFrame:
    """(key, win int, s string) for every window of every sequence; empty and null sequences have none."""
    d = df.select(F.col(key), F.col(seq).alias("__seq")).where("length(__seq) > 0")
    return d.select(key, F.posexplode(dna.windows(F.col("__seq"), p)).alias("win", "s"))


def sketch_sql(df: DataFrame, key: str, seq: str, p: SketchParams) -> DataFrame:
    """(key, win, feature) by higher-order functions alone."""
    return sequence_windows(df, key, seq, p).select(key, "win", F.explode(features.sketch(F.col("s"), p)).alias("feature"))


def sketch_numpy(letters: np.ndarray, starts: np.ndarray, p: SketchParams, policy: tuple[features.FeatureHash, features.Selection]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of sequences, window numbers and features, of sequences that lie side by side in letters: starts has where each
    begins (and the last ends). Python's work grows with blocks of windows and not with sequences."""
    size = np.diff(starts)
    own = np.flatnonzero(size >= p.k)
    if not len(own):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    hasher, selection = policy
    c = _CODE[letters]
    base = c & 3
    bad = np.concatenate([[0], np.cumsum(c == 4)])
    kind = np.uint32 if hasher.bits == 32 else np.uint64
    none_value = kind(hasher.none)
    plain = bad[p.k :] == bad[: -p.k]
    if selection.numpy is not None:
        plain &= selection.numpy(base, p.k)
    h = np.where(plain, hasher.numpy(features.canonical_codes(base, p.k)).astype(kind), none_value)
    n = size[own]
    count = np.where(n <= p.window, 1, (n - p.window) // p.stride + 1)
    count += (n > p.window) & (count * p.stride < n)
    # all windows one after another: their sequences, their numbers, and where they and their sequences' k-mers end
    which = np.repeat(own, count)
    win = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    begin, end = starts[which] + win * p.stride, starts[which + 1] - p.k
    at = np.arange(max(1, p.window - p.k + 1))
    found = []
    for lo in range(0, len(which), _ROWS):
        places = begin[lo : lo + _ROWS, None] + at
        inside = places <= end[lo : lo + _ROWS, None]
        rows = np.where(inside, h[np.where(inside, places, 0)], none_value)
        rows.sort(axis=1)
        new = rows != none_value
        new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        new &= np.cumsum(new, axis=1, dtype=np.int32) <= p.size
        r, col = np.nonzero(new)
        found.append((r + lo, rows[r, col].astype(np.int64)))
    r = np.concatenate([x for x, _ in found])
    return which[r], win[r].astype(np.int32), np.concatenate([x for _, x in found])


def _parts(df: DataFrame, key: str, seq: str, p: SketchParams) -> DataFrame:
    """(key, seq binary, before int, most int): sequences as runs of at most PART_WINDOWS windows, with how many windows lie
    before a run and how many are its own; so that no worker holds more than a run of any sequence."""
    letters, run = F.length(f"`{seq}`"), PART_WINDOWS * p.stride
    last = F.greatest(F.ceil((letters - p.window) / run).cast("int") - 1, F.lit(0))
    d = df.where(letters > 0).select(F.col(key).cast("long").alias(key), F.col(seq).cast("binary").alias("__seq"), last.alias("__last"))
    d = d.select(key, "__seq", "__last", F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("__i"))
    start = F.col("__i") * run + 1
    part = F.when(F.col("__last") == 0, F.col("__seq")).when(F.col("__i") < F.col("__last"), F.substring(F.col("__seq"), start, F.lit(run - p.stride + p.window))).otherwise(F.substring(F.col("__seq"), start, F.length("__seq")))
    return d.select(key, part.alias("__seq"), (F.col("__i") * PART_WINDOWS).alias("__before"), F.when(F.col("__i") < F.col("__last"), PART_WINDOWS).otherwise(2**31 - 1).alias("__most"))


def sketch_arrow(df: DataFrame, key: str, seq: str, p: SketchParams) -> DataFrame:
    """The same rows as sketch_sql, by numpy on Arrow batches; key must be a long."""
    policy = features.policy(p)

    def run(batches):
        for b in batches:
            key_of, before, most = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            letters, starts = dna.flat(b.column(1))
            lo = 0
            while lo < b.num_rows:  # sequences of some letters together, one at least
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _LETTERS, side="right")) - 1)
                which, win, feature = sketch_numpy(letters[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], p, policy)
                which += lo
                own = win < most[which]
                which, win, feature = which[own], win[own] + before[which[own]], feature[own]
                if len(win):
                    yield pa.RecordBatch.from_arrays([pa.array(key_of[which]), pa.array(win.astype(np.int32)), pa.array(feature)], names=[key, "win", "feature"])
                lo = hi

    return _packed(_parts(df, key, seq, p), run, f"{key} long, win int, feature long")


def _packed(d: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with output batches of some size, whatever the size that run yields."""

    def joined(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return d.mapInArrow(joined, schema)


def sketch_features(df: DataFrame, key: str, seq: str, p: SketchParams = SketchParams(), engine: str = "arrow") -> DataFrame:
    """(key, win, feature) rows; engine "sql" keeps all work in the JVM, "arrow" is the faster one."""
    return (sketch_arrow if engine == "arrow" else sketch_sql)(df, key, seq, p)


def read_features(reads: DataFrame, p: SketchParams = SketchParams(), engine: str = "arrow") -> DataFrame:
    """(query_id, feature, n): how many windows of both mates of a read have the feature."""
    parts = [sketch_features(reads.where("length(header) > 0 and length(seq1) > 0"), "query_id", s, p, engine) for s in ("seq1", "seq2")]
    return parts[0].unionByName(parts[1]).groupBy("query_id", "feature").agg(F.count("*").alias("n"))


def kmer_intersection(a: DataFrame, b: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key_a, key_b, shared): canonical k-mer occurrences in b's sequences that are in a's set, for pairs that share any."""

    def own(df: DataFrame) -> DataFrame:
        plain = F.filter(dna.kmers(F.upper(F.col(seq)), k), dna.unambiguous)
        return df.select(key, F.explode(F.transform(plain, dna.canonical)).alias("kmer"))

    left = own(a).distinct().withColumnRenamed(key, "key_a")
    right = own(b).groupBy(key, "kmer").count().withColumnRenamed(key, "key_b")
    return left.join(right, "kmer").groupBy("key_a", "key_b").agg(F.sum("count").alias("shared"))
