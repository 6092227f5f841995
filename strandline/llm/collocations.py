"""Phrase collocations: frequent phrases of two to four words, scored by how much they are more than their parts.

Two passes over the texts. The first counts all phrases of one to four words in a count-min sketch: two rows of cells, a phrase
adds to one cell of each by its hash. Tasks send the cells that they touched by ranges of cells, ranges are merged by addition,
and one bit a cell says whether it reached the least count. A cell never holds less than any of its phrases, so what is frequent
always passes. The second pass keeps only phrases all of whose parts pass in both rows, and counts these exactly, by their
words. Phrases that pass for other phrases' counts are dropped by the exact count: results do not depend on the sketch's size.

The sketch grows with the corpus, to MOST_CELLS cells a row (two bitmaps of 128 MB in each task). With some 20 phrases a cell
the filter is still sharp, which is 20 billion occurrences of phrases; on larger corpora more infrequent phrases pass and the
second pass shuffles more of them, combined before the shuffle, unless most_cells is raised with the executors' memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textvec import LOWER, joined, mix, pack, row_ranges, stream, text_buffer, unpack, word_codes, words_of

#: Bytes that end a piece; between the words of a piece stand blanks and tabs alone.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True

LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer phrase that has so many hundredths of a phrase's occurrences stands for it.
SUBSUMES = 80
#: Cells of one row: one for so many bytes of text, between the two limits.
BYTES_A_CELL, FEWEST_CELLS, MOST_CELLS = 16, 1 << 16, 1 << 30
#: Ranges of cells in a row; a task merges one or more, with counters of about so many bytes.
RANGES, _COUNTER_BYTES = 128, 32 << 20
_SLICE_BYTES, _MOST_DOCS, _CHUNK = 1 << 19, 1 << 16, 1 << 21
#: Text whose exact counts one task adds up before the shuffle: a phrase found in every task is sent once for each.
_COUNTED_BYTES = 128 << 20
_STEP = stream(31, LONGEST + 1) | np.uint64(1)


class Slice:
    """Words of some texts, and at which words a phrase of k words inside one piece starts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray) -> None:
        base = int(off[0])
        self.words = words_of(LOWER[data[base : int(off[-1])]], off - base, SEPARATORS)
        w = self.words
        self.doc = w.doc
        self.lang = langs[self.doc]
        ends = BREAKS[w.data]
        piece = np.cumsum(ends, dtype=np.int32)[w.start] if len(w.start) else np.zeros(0, dtype=np.int32)
        w.data[ends] = 0x20  # hashes() takes only white space between words
        follows = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        n = len(w.start)
        self.starts = [np.ones(n, dtype=bool)]  # of k = 1, 2, ...
        for k in range(2, LONGEST + 1):
            last = self.starts[-1]
            self.starts.append(np.zeros(n, dtype=bool))
            if n >= k:
                self.starts[-1][: n - k + 1] = last[: n - k + 1] & follows[k - 2 :]

    def hashes(self, seeds: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ... a 64-bit hash of language and phrase at every word; only places in starts[k - 1] have a meaning."""
        one = mix(self.words.hashes(lower=False) + seeds[self.doc])
        out = [one]
        for k in range(2, LONGEST + 1):
            next_ = np.zeros_like(one)
            next_[: -(k - 1)] = one[k - 1 :]
            out.append(mix(out[-1] * _STEP[k] + next_))
        return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, np.ndarray, list[str]]]:
    """Slices of batches (lang, text), each with a seed for every text's language, and the names of its language numbers."""
    for b in batches:
        data, off = text_buffer(b.column("text"))
        coded = b.column("lang").dictionary_encode()
        names, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], dtype=np.uint64)
        for lo, hi in row_ranges(off, _SLICE_BYTES, _MOST_DOCS):
            yield Slice(data, off[lo : hi + 1], numbers[lo:hi]), seed[numbers[lo:hi]], names


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of hashes in both rows of a sketch of 2**bits cells a row: by the low and by the high half of the hash."""
    mask = np.uint32((1 << bits) - 1)
    return h.astype(np.uint32) & mask, (h >> np.uint64(32)).astype(np.uint32) & mask


def _pieces(hashes: list[np.ndarray], bits: int, most: int) -> Iterator[tuple[int, bytes, bytes]]:
    """What hashes add to a sketch: (range of cells, cells in it, counts up to most)."""
    h = np.concatenate(hashes)
    width = 1 << (bits - RANGES.bit_length() + 1)
    for row, own in enumerate(cells(h, bits)):
        own.sort()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.minimum(np.diff(np.append(first, len(own))), most)
        own = own[first].astype(np.uint64)
        bounds = np.searchsorted(own, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(width))
        for r in np.flatnonzero(np.diff(bounds)):
            part = own[bounds[r] : bounds[r + 1]] - np.uint64(r * width)
            yield row * RANGES + int(r), pack(np.diff(part, prepend=np.uint64(0))), pack(count[bounds[r] : bounds[r + 1]].astype(np.uint64))


def sketch(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """Bitmaps of the cells that reached least, one row of 2**bits bits for each row of the sketch; docs (lang, text).

    A range's cells are merged as its pieces arrive, so a task holds the counters of its ranges, whatever the number of pieces.
    """
    width = 1 << (bits - RANGES.bit_length() + 1)

    @common.thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(hashes: list[np.ndarray]) -> pa.RecordBatch:
            rows = list(_pieces(hashes, bits, least))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["range", "cells", "counts"])

        held, n = [], 0
        for s, seeds, _ in slices(batches):
            for h, at in zip(s.hashes(seeds) if len(s.doc) else (), s.starts):
                held.append(h[at])
                n += len(held[-1])
            if n >= _CHUNK:
                yield batch(held)
                held, n = [], 0
        if n:
            yield batch(held)

    @common.thrifty
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = counters.setdefault(r, np.zeros(width, dtype=np.uint32))
                own[np.cumsum(unpack(c)).astype(np.int64)] += unpack(k).astype(np.uint32)
        for r, own in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

    tasks = min(2 * RANGES, common.blocks_for(2 * RANGES * width * 4, _COUNTER_BYTES))
    parts = docs.mapInArrow(count, "range int, cells binary, counts binary").repartition(tasks, "range").mapInArrow(merge, "range int, bits binary")
    out = np.zeros((2 * RANGES, width // 8), dtype=np.uint8)
    for r in parts.collect():  # at most 2 * RANGES rows, whose size is the sketch's own bound
        out[r["range"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(2, -1)


def passes(bitmaps: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both cells of each hash reached the least count."""
    ok = np.ones(len(h), dtype=bool)
    for row, own in zip(bitmaps, cells(h, (8 * bitmaps.shape[1]).bit_length() - 1)):
        ok &= (row[own >> np.uint32(3)] >> (own & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return ok


def survivors(s: Slice, seeds: np.ndarray, bitmaps: np.ndarray) -> list[np.ndarray]:
    """For k = 1, 2, ... the words at which a phrase starts all of whose parts pass the sketch."""
    ok, out = np.zeros(0, dtype=bool), []
    for k, (h, at) in enumerate(zip(s.hashes(seeds), s.starts), 1):
        some = at.copy()
        if k > 1:
            some[:-1] &= ok[1:]
            some &= ok
        where = np.flatnonzero(some)
        where = where[passes(bitmaps, h[where])]
        ok = np.zeros(len(at), dtype=bool)
        ok[where] = True
        out.append(where)
    return out


def exact_counts(s: Slice, kept: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ...: (words of each different phrase, one row for each; its language number; its occurrences).

    A phrase's number is that of its first k - 1 words beside its last word's: equal numbers are equal words, without hashes.
    """
    word = np.unique(word_codes(s.words, SEPARATORS) * (int(s.lang.max(initial=0)) + 1) + s.lang, return_inverse=True)[1]
    number = word
    for k, where in enumerate(kept, 1):
        key = word[where] if k == 1 else number[where] << 32 | word[where + (k - 1)]
        _, first, own, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        number = np.zeros(len(word), dtype=np.int64)
        number[where] = own
        at = where[first]
        yield at[:, None] + np.arange(k), s.lang[at], count


_COUNTS = "lang string, phrase string, k int, f long"


def frequent(docs: DataFrame, least: int = LEAST, most_cells: int = MOST_CELLS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, k (its words), f (its occurrences): all phrases of one to four words with f >= least, stored.

    One row more for each language has no phrase, k = 0 and all its words. Null languages are `und`, null texts empty; a row
    that is there twice counts twice; other columns are not looked at. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = common.text_bytes(d)
    size = min(max(n_bytes // BYTES_A_CELL, FEWEST_CELLS), most_cells)
    held = docs.sparkSession.sparkContext.broadcast(sketch(d, (size - 1).bit_length(), least))

    @common.thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(names: list[str], lang: np.ndarray, phrase: pa.Array, k: int, f: np.ndarray) -> pa.RecordBatch:
            langs = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs, phrase.cast(pa.string()), pa.array(np.full(len(f), k, dtype=np.int32)), pa.array(f.astype(np.int64))], names=["lang", "phrase", "k", "f"])

        for s, seeds, names in slices(batches):
            words = np.bincount(s.lang, minlength=len(names))
            there = np.flatnonzero(words)
            yield rows(names, there, pa.nulls(len(there), pa.string()), 0, words[there])
            if len(there):
                for k, (chosen, lang, f) in enumerate(exact_counts(s, survivors(s, seeds, held.value)), 1):
                    yield rows(names, lang, joined(s.words, chosen), k, f)

    f = d.coalesce(common.blocks_for(n_bytes, _COUNTED_BYTES)).mapInArrow(count, _COUNTS).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return common.stored(f.where(F.col("k").eqNullSafe(0) | (F.col("f") >= least)), "phrases")


def _parts(k_from: str, k_to: str) -> str:
    """SQL: every contiguous part of w, of k_from to k_to words."""
    return f"flatten(transform(sequence({k_from}, {k_to}), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))"


def collocations(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first top phrases by score: lang, rank, phrase, a, l, r, n, score; phrases as frequent() gives them.

    The score is that of the cut whose parts are most frequent together: floor(2 000 000 a / (l + r)); equal ones go to the
    first. Phrases that are nearly always part of a longer frequent one are left out. Equal scores go by a, then by phrase.
    """
    g = phrases.where("k > 0")
    w = F.split("phrase", " ")
    long = g.where("k > 1").withColumn("w", w)
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("transform(sequence(1, k - 1), i -> struct(i as cut, array_join(slice(w, 1, i), ' ') as left, array_join(slice(w, i + 1, k - i), ' ') as right))")).alias("c")).select("lang", "phrase", "a", "c.*")
    side = lambda name, f: common.bounded_broadcast(g.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)), 200)
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * exact("a"), exact("l") + exact("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    covers = long.where("k > 2").select("lang", F.explode(F.expr(_parts("2", "size(w) - 1"))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").where((F.lit(100) * exact("longer") < F.lit(SUBSUMES) * exact("a")) | F.col("longer").isNull())
    totals = common.bounded_broadcast(phrases.where("k = 0").select("lang", F.col("f").alias("n")), 200)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of documents."""
    return collocations(frequent(common.table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM documents, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS u(piece)
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM pieces, unnest([1, 2, 3, 4]) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i) GROUP BY ALL HAVING count(*) >= 30
), long AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
cuts AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS lhs, array_to_string(w[i + 1:k], ' ') AS rhs FROM long, unnest(range(1, k)) AS u(i)),
scored AS (
  SELECT c.lang, c.phrase, c.a, i, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.lhs JOIN grams y ON y.lang = c.lang AND y.phrase = c.rhs
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM long, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(i)),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100::HUGEINT * o.a >= 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
