"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

The trees are trained here, with numpy alone, on a bounded sample of labelled documents; some statistics may only lower the
score (monotonic constraints). They are flattened into node arrays, so that a batch is scored level by level for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import MOST_DOCS, SHINGLE_BITS, SPACE, row_ranges, runs, text_buffer, words_of

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Rows that the trees are trained on: the labelled documents whose hashed ids are smallest.
SAMPLE = 20_000
_SLICE_BYTES = 1 << 18
_WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see, and the direction in which each may move the score (0: either).
FEATURES = {"log_words": 0, "chars_per_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "sign_words": -1, "digit_share": 0, "upper_share": 0, "exclaim_share": -1, "stop_share": 0, "distinct_share": 0, "words_per_line": 0, "same_as_before": -1, "other_share": 0}

_CLASS = np.zeros(256, dtype=np.uint8)  # of each byte: 1 symbol, 2 digit, 3 upper case, 4 exclamation mark, 5 full stop, 6 control or other odd sign
for _i, _own in enumerate((SYMBOLS, b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b".", b"@^_~`\\{}[]=+"), 1):
    _CLASS[list(_own)] = _i
#: Whether a byte is an ASCII sign: printable, neither letter nor digit.
_SIGN = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts data[off[i]:off[i + 1]] (at most MOST_DOCS): the counts of COUNTS, and the statistics of FEATURES."""
    n = len(off) - 1
    words = words_of(data, off)
    b, base = words.data, int(off[0])
    at = off - base

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[at[1:]] - c[at[:-1]]

    n_words = words.counts
    kind = _CLASS[b]
    word_chars = per_text(((b & 0xC0) != 0x80) & ~SPACE[b])
    per_kind = [per_text(kind == i) for i in range(1, 7)]
    h = words.hashes(lower=False)
    # words in windows that are found twice
    low = np.uint64((1 << SHINGLE_BITS) - 1)
    window, doc = runs(h, words.first, _WINDOW)
    key = doc.astype(np.uint64) << np.uint64(SHINGLE_BITS) | (window & low)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeat = np.zeros(n, dtype=np.int64)
    if len(twice):
        where = np.searchsorted(twice, key)
        found = np.flatnonzero(twice[np.minimum(where, len(twice) - 1)] == key)
        first = found - (np.cumsum(np.maximum(n_words - (_WINDOW - 1), 0)) - np.maximum(n_words - (_WINDOW - 1), 0))[doc[found]] + words.first[doc[found]]
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + _WINDOW, -1)
        c = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        repeat = c[words.first[1:]] - c[words.first[:-1]]
    # lines with a word that repeat an earlier one
    dup, lines = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    raw = b.tobytes()
    broken = per_text(b == 0x0A)
    for i in np.flatnonzero(broken):
        seen: set[bytes] = set()
        own = raw[at[i] : at[i + 1]].split(b"\n")
        lines[i] = len(own)
        for x in own:
            if x in seen:
                dup[i] += 1
            elif x.strip(b" \t\n\v\f\r"):
                seen.add(x)
    # distinct words, and words equal to the one before
    wdoc = words.doc
    wkey = np.sort(wdoc.astype(np.uint64) << np.uint64(SHINGLE_BITS) | (h & low))
    new = np.concatenate([[True], wkey[1:] != wkey[:-1]]) if len(wkey) else np.zeros(0, dtype=bool)
    distinct = np.bincount((wkey[new] >> np.uint64(SHINGLE_BITS)).astype(np.int64), minlength=n)
    same = np.bincount(wdoc[1:][(h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])], minlength=n) if len(h) else np.zeros(n, dtype=np.int64)
    # words that are one sign alone: what stands between the entries of menus and tables
    alone = (words.end - words.start == 1) & _SIGN[b[words.start]] if len(h) else np.zeros(0, dtype=bool)
    signs = np.bincount(wdoc[alone], minlength=n)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    counts = np.stack([n_words, word_chars, per_kind[0], dup, repeat], axis=1)
    x = np.stack([np.log1p(n_words), word_chars / w, per_kind[0] / c, dup / lines, repeat / w, signs / w, per_kind[1] / c, per_kind[2] / c, per_kind[3] / c, per_kind[4] / w, distinct / w, n_words / lines, same / w, per_kind[5] / c], axis=1)
    return counts, x.astype(np.float64)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in heap order: feature and threshold of inner nodes, values of leaves, one row for each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability for each row of x: all rows go down a level at once."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += v[at - len(f)]
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, direction: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels y, by second-order steps over histograms of quantile bins.

    direction: -1 or 1 where a feature may only lower or raise the score. A split against it is not taken, and the halves
    of a split in it are bounded by their mean, which keeps whole trees monotonic. With fewer than two classes there are
    no trees, and the score is the smoothed share of ones.
    """
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = [], [], []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for j in range(m)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
        score = np.full(n, start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            f, t, v = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(leaves)
            at = np.zeros(n, dtype=np.int64)
            bound = {0: (-np.inf, np.inf)}
            for node in range(inner):
                lo, hi = bound[node]
                own = np.flatnonzero(at == node)
                best = (1e-6, None)
                if len(own):
                    total_g, total_h = g[own].sum(), h[own].sum()
                    clip = lambda a, b: np.clip(a / (b + ridge), lo, hi)
                    gain = lambda a, b, w: a * w - 0.5 * (b + ridge) * w * w
                    base = gain(total_g, total_h, clip(total_g, total_h))
                    for j in range(m):
                        k = len(cuts[j])
                        if not k:
                            continue
                        hg = np.bincount(code[own, j], g[own], k + 1).cumsum()[:-1]
                        hh = np.bincount(code[own, j], h[own], k + 1).cumsum()[:-1]
                        wl, wr = clip(hg, hh), clip(total_g - hg, total_h - hh)
                        better = gain(hg, hh, wl) + gain(total_g - hg, total_h - hh, wr) - base
                        better[(hh < least) | (total_h - hh < least) | ((wr - wl) * direction[j] < 0)] = 0
                        i = int(np.argmax(better))
                        if better[i] > best[0]:
                            best = (better[i], (j, i, float(wl[i]), float(wr[i])))
                left, right = bound[node], bound[node]
                if best[1]:
                    j, i, wl, wr = best[1]
                    f[node], t[node] = j, cuts[j][i]
                    middle = (wl + wr) / 2
                    if direction[j]:
                        left, right = ((lo, middle), (middle, hi)) if direction[j] > 0 else ((middle, hi), (lo, middle))
                bound[2 * node + 1], bound[2 * node + 2] = left, right
                at[own] = 2 * node + 1 + (x[own, f[node]] > t[node])
            leaf = at - inner
            lg, lh = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
            for i in range(leaves):
                v[i] = rate * np.clip(lg[i] / (lh[i] + ridge), *bound[inner + i])
            score += v[leaf]
            feature.append(f)
            threshold.append(t)
            value.append(v)
    shape = lambda a, k, kind: np.array(a, dtype=kind).reshape(-1, k)
    return Trees(shape(feature, inner, np.int64), shape(threshold, inner, np.float64), shape(value, leaves, np.float64), start)


_STATISTICS = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, x array<double>"


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts, and x, the statistics that the trees see; null text has no words."""

    @common.thrifty
    def run(batches):
        for b in batches:
            data, off = text_buffer(b.column("text"))
            for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS):
                counts, x = statistics(data, off[lo : hi + 1])
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(c) for c in counts.T), lists], names=["doc_id", *COUNTS, "x"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, _STATISTICS)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most sample labelled documents (doc_id, quality 0/1); null labels and ids are left out."""
    common.small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    quality = {r.doc_id: r.quality for r in chosen.collect()}  # at most sample rows
    if not quality:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()))
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in quality], "doc_id long"))
    rows = document_statistics(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")).select("doc_id", "x").toArrow()
    known = rows.column("doc_id").to_pylist()
    order = np.argsort(known, kind="stable")
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))[order]
    y = np.array([quality[known[i]] for i in order], dtype=np.float64)
    return train(x, (y > 0).astype(np.float64), list(FEATURES.values()))


def _verdicts(trees: Trees, counts: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
    score = trees.score(x)
    return failed, score, ~failed & (score >= least)


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed, score, kept: one row for each input row, other columns are dropped.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows of eight. kept: not failed, and the trees
    give at least least. Null text has no words, so it fails; null ids stay null; repeated rows get the same verdict.
    """
    trees = learn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    @common.thrifty
    def run(batches):
        for b in batches:
            data, off = text_buffer(b.column("text"))
            for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS):
                counts, x = statistics(data, off[lo : hi + 1])
                verdict = _verdicts(held.value, counts, x, least)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(c) for c in counts.T), *map(pa.array, verdict)], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Same rules as judge()."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs.select("doc_id", F.col(text_col).alias("text")), labels))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        data, off = text_buffer(texts)
        kept = [_verdicts(held.value, *statistics(data, off[lo : hi + 1]), least)[2] for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS)]
        common.release()
        return pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=bool))

    return docs.where(good(F.coalesce(F.col(text_col), F.lit(""))))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
