"""Periodic runs of words: maximal stretches that repeat with a smallest period.

For the texts of a slice: ranks of all factors of 1, 2, 4, ... words (prefix doubling) give the suffix array and, compared from
long to short, common extensions of any two places; suffix array and neighbours' common prefixes (LCP) give each place's
longest previous factor (LPF), and these the Lempel-Ziv blocks. A run that touches a border of two blocks is found by Main's
extensions to both sides of that border for every period that the blocks allow; a run inside a block is a copy of one that
lies inside the block's earlier occurrence, so buckets of runs by their starts are copied from left to right.

Each text is searched by itself: no shuffle. Memory follows the longest text: 4 bytes a word for each doubling, of which
there are as many as the longest factor found twice has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import Words, row_ranges, text_buffer, word_codes, words_of

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
_SLICE_BYTES = 1 << 19
_MOST_DOCS = 1 << 14
#: Pairs of border and period that are tried at once.
_PAIRS = 1 << 20


class Factors:
    """Ranks of the factors of 2^k symbols at every place of a sequence whose first and last symbols are found once."""

    def __init__(self, codes: np.ndarray, most_levels: int = 64) -> None:
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        sorted_codes = codes[order]
        new = np.ones(n, dtype=bool)
        new[1:] = sorted_codes[1:] != sorted_codes[:-1]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        open_ = order[~alone]
        self.ranks = [rank]
        while len(open_) and len(self.ranks) < most_levels:
            width = 1 << (len(self.ranks) - 1)
            # a factor found twice ends before the last symbol, so there is always a next one
            pair = rank[open_].astype(np.int64) * n + rank[open_ + width]
            by = np.argsort(pair, kind="stable")
            open_, pair = open_[by], pair[by]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = pair[1:] != pair[:-1]
            old = rank[open_]
            group = np.ones(len(old), dtype=bool)
            group[1:] = old[1:] != old[:-1]
            at = np.arange(len(pair))
            first = np.maximum.accumulate(np.where(new, at, 0))
            begin = np.maximum.accumulate(np.where(group, at, 0))
            rank = rank.copy()
            rank[open_] = old + (first - begin)
            self.ranks.append(rank)
            open_ = open_[~(new & np.append(new[1:], True))]
        self.open = open_

    def suffix_array(self) -> np.ndarray:
        sa = np.empty(len(self.ranks[-1]), dtype=np.int64)
        sa[self.ranks[-1]] = np.arange(len(sa))
        return sa

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i and j on are equal, i <> j."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):  # the last level has no equal ranks
            out += (self.ranks[k][i + out] == self.ranks[k][j + out]).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols at places i and j and before them are equal, i <> j."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            out += (inside & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest factor that also starts earlier, and where; lcp[r] belongs to suffixes r - 1 and r.

    A stack holds suffixes by ascending places: the nearest earlier place on either side in the array gives the factor.
    """
    length, source = np.zeros(len(sa), dtype=np.int64), np.full(len(sa), -1, dtype=np.int64)
    shared = lcp > 0
    some = np.flatnonzero(shared | np.append(shared[1:], False))  # suffixes whose first symbol is found twice
    stack_at, stack_lcp, at, found, where = [], [], [], [], []
    for place, common_ in zip([*sa[some].tolist(), -1], [*lcp[some].tolist(), 0]):
        while stack_at and place < stack_at[-1]:
            own, before = stack_at.pop(), stack_lcp.pop()
            at.append(own)
            if before >= common_:
                found.append(before)
                where.append(stack_at[-1] if before else -1)
            else:
                found.append(common_)
                where.append(place)
                common_ = before
        stack_at.append(place)
        stack_lcp.append(common_)
    length[at] = found
    source[at] = where
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """First places of the Lempel-Ziv blocks: each is the longest factor found before, or one new symbol."""
    steps, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return np.array(starts, dtype=np.int64)


def _distinct(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), the smallest period of each stretch alone: larger ones are its multiples."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def border_runs(f: Factors, starts: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs (start, end, period) that contain or touch the first place of a block.

    The block before, with the symbol behind it, is found nowhere earlier. So a run reaches less than a period beyond that
    block's first place, and as a run that ends in this block it has a period of at most (both lengths - 1) / (times - 1).
    """
    n, codes = len(f.ranks[0]), f.ranks[0]
    size = np.diff(np.append(starts, n))
    most = (size[1:] + size[:-1] - 1) // (times - 1)
    border, total = starts[1:], np.concatenate([[0], np.cumsum(most)])
    out = np.zeros((0, 3), dtype=np.int64)
    for lo in range(0, int(total[-1]), _PAIRS):
        flat = np.arange(lo, min(lo + _PAIRS, int(total[-1])))
        own = np.searchsorted(total, flat, side="right") - 1
        b, q = border[own], flat - total[own] + 1
        for i in (b, b - q):  # a period to the right of the border, and one to its left
            inside = (i >= 1) & (i + q < n)
            x, y = i[inside], q[inside]
            some = (codes[x] == codes[x + y]) | (codes[x - 1] == codes[x + y - 1])
            x, y = x[some], y[some]
            right, left = f.forward(x, x + y), f.backward(x - 1, x + y - 1)
            long = left + right + y >= np.maximum(least, times * y)
            x, y, right, left = x[long], y[long], right[long], left[long]
            out = _distinct(np.concatenate([out, np.stack([x - left, x + y + right, y], axis=1)]))
    return out


def runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs (start, end, period) of a sequence, by start and end. Its first and last symbols must be found once.

    least: words that a run has at least; times: periods that it has at least (2 or more).
    """
    f = Factors(codes)
    sa = f.suffix_array()
    lcp = np.concatenate([[0], f.forward(sa[:-1], sa[1:])])
    length, source = previous_factors(sa, lcp)
    starts = blocks(length)
    found = border_runs(f, starts, least, times)
    buckets: dict[int, dict[int, int]] = {}
    for s, e, q in found.tolist():
        buckets.setdefault(s, {})[e] = q
    size = length[starts]
    for i in np.flatnonzero(size >= least + 2) if buckets else ():
        b, end = int(starts[i]), int(source[starts[i]] + size[i])
        shift = b - int(source[b])
        for s in range(b - shift + 1, end - least):
            for e, q in buckets.get(s, {}).items():
                if e < end:
                    buckets.setdefault(s + shift, {})[e + shift] = q
    return np.array(sorted((s, e, q) for s, own in buckets.items() for e, q in own.items()), dtype=np.int64).reshape(-1, 3)


def _sequence(codes: np.ndarray, first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts own one after the other, symbols of different texts different, with a symbol found once before,
    between and behind them; and where each text starts in it."""
    n = np.diff(first)[own]
    begin = np.cumsum(n + 1) - n
    doc = np.repeat(np.arange(len(own)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full(int(n.sum()) + len(own) + 1, -1, dtype=np.int64)
    out[at + begin[doc]] = doc * (int(codes.max(initial=0)) + 1) + codes[at + first[own][doc]]
    bare = np.flatnonzero(out < 0)
    out[bare] = int(out.max(initial=0)) + 1 + np.arange(len(bare))
    return out, begin


def slice_runs(words: Words, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text its runs (start, end, period), places counted from its first word.

    A run holds two equal factors of least - period and (times - 1) * period words, so texts without any factor of that many words
    found twice have none and are left out before the search.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    found = [none] * len(words.counts)
    codes = word_codes(words)
    long = np.flatnonzero(words.counts >= least)
    same = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))  # words that any run repeats at least
    if len(long):
        sequence, begin = _sequence(codes, words.first, long)
        twice = Factors(sequence, same.bit_length()).open  # places of factors of 2 ** (bit_length - 1) <= same words
        long = long[np.unique(np.searchsorted(begin, twice, side="right") - 1)]
    if len(long):
        sequence, begin = _sequence(codes, words.first, long)
        all_ = runs(sequence, least, times)
        doc = np.searchsorted(begin, all_[:, 0], side="right") - 1
        bounds = np.searchsorted(doc, np.arange(len(long) + 1))
        for i, d in enumerate(long):
            own = all_[bounds[i] : bounds[i + 1]]
            found[d] = own - np.array([begin[i], begin[i], 0])
    return found


def collapsed(words: Words, found: list[np.ndarray]) -> pa.Array:
    """Texts of the words that no run repeats, joined by one space: of each run the first period stays."""
    n = len(words.start)
    cover = np.zeros(n + 1, dtype=np.int64)
    for first, own in zip(words.first, found):
        np.add.at(cover, own[:, 0] + own[:, 2] + first, 1)
        np.add.at(cover, own[:, 1] + first, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    size = (words.end - words.start)[kept] + 1  # with a space behind each
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    at = np.repeat(words.start[kept] - ends[:-1], size - 1)
    inside = np.ones(len(out), dtype=bool)
    inside[ends[1:] - 1] = False
    to = np.flatnonzero(inside)
    out[to] = words.data[to + at]
    bounds = ends[np.searchsorted(kept, words.first)]
    raw = out.tobytes()
    return pa.array([raw[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.large_string())


SCHEMA = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs by start and period, collapsed: the text without what runs repeat, words joined by one space.

    One row for each input row; other columns are dropped, whatever their names. Null and empty texts have no words, no runs
    and an empty collapsed text; null ids stay null; repeated rows give the same each.
    """

    @common.thrifty
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(b.column("text"))
            for lo, hi in row_ranges(off, _SLICE_BYTES, _MOST_DOCS):
                words = words_of(data, off[lo : hi + 1])
                found = slice_runs(words, least, times)
                all_ = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found])
                order = np.lexsort((all_[:, 2], all_[:, 0], np.repeat(np.arange(len(found)), [len(x) for x in found])))
                all_ = all_[order]
                values = pa.StructArray.from_arrays([pa.array(all_[:, 0]), pa.array(all_[:, 1] - all_[:, 0]), pa.array(all_[:, 2])], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(words.counts), lists, collapsed(words, found)], names=["doc_id", "n_words", "runs", "collapsed"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(work, SCHEMA)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which one text of ten repeats itself from one of its words on, by the checksum of its id.

    With h the checksum, g = h / 10 and n words: words from a = g mod n on repeat the p = 1 + (n - a) / (3 + g mod 8) words
    there. Such a text's words are joined by one space; all other texts, also those without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    of = lambda c: c.cast("int")
    unit: Column = F.slice(words, of(a + 1), of(p))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), of(a)), F.flatten(F.array_repeat(unit, of(F.ceil((n - a) / p))))), F.lit(1), n)
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(F.col("text")))


def summaries(found: DataFrame) -> DataFrame:
    """One row for each row of find_runs(): the run of the highest exponent, and digests of all runs and of the collapsed text."""
    higher = lambda x, y: x["length"].cast("decimal(19,0)") * y["period"] > y["length"].cast("decimal(19,0)") * x["period"]
    best = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda b, x: F.when(higher(x, b), x).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one of ten made periodic first."""
    docs = common.table(spark, sf_dir, "documents")
    return summaries(find_runs(with_periods(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))))


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda j: (-1)::BIGINT))))),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT) AS h
  FROM documents
), sized AS (SELECT row, doc_id, w, len(w) AS n, h, h // 10 AS g FROM words),
edits AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM sized WHERE h % 10 = 0 AND n > 0),
texts AS (
  SELECT row, doc_id, n, w FROM sized WHERE NOT coalesce(h % 10 = 0 AND n > 0, false)
  UNION ALL SELECT row, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) FROM edits
), grams AS (SELECT row, n, i, array_to_string(w[i + 1:i + 16], ' ') AS gram FROM texts, unnest(range(n - 15)) AS u(i) WHERE n >= 24),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row, q, min(i) AS start, count(*) + 15 + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
dropped AS (SELECT DISTINCT row, start + period + u.i AS i FROM runs, unnest(range(length - period)) AS u(i)),
kept AS (SELECT t.row, u.i, t.w[u.i + 1] AS word FROM texts t, unnest(range(t.n)) AS u(i) ANTI JOIN dropped d ON d.row = t.row AND d.i = u.i),
joined AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY row),
per AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({'start': start, 'length': length, 'period': period} ORDER BY length::DOUBLE / period DESC, start, period) AS best
  FROM runs GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN per USING (row) LEFT JOIN joined USING (row)"""
