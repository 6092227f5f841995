"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, and weighted votes.

Features are words (A-Z lowered, outer punctuation removed) and their beginnings of 5 to 8 bytes: all of the labelled
sample, however rare. A document is a vector of (1 + log tf) * idf * label weight over them; idf comes from counts over all
documents, and the label weight, a supervised term weight learned from the labelled sample, grows
smoothly with how far and how surely the feature goes along with the label (see label_weight), and one more entry that every
document has and that grows with its length: it keeps a stray match in a long text from looking like a text that consists of
such words. Equal example vectors are one entry with summed votes.

The index lists each feature's examples in blocks of neighbours, with the largest weight of each block. A query sums
the postings of its heaviest features into a bound for each block, visits blocks by falling bound, stops when no block left
can reach its k-th best, and completes the cosines of what is left: the result equals that of comparing with all examples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import LOWER, MOST_DOCS, SHINGLE_BITS, Words, mix, pack, row_ranges, stream, text_buffer, unpack, words_of

#: Labelled documents of each label that examples are drawn from (smallest hashed ids).
SAMPLE = 4_000
#: Neighbours that vote, and examples in a block: the index has a cell for each feature and block, and features are many.
NEAREST, BLOCK = 15, 512
#: Norm of the part of a query's unit vector whose postings are not read.
_LIGHT = 0.01
_SLICE_BYTES = 1 << 18
#: Features whose postings are put in order at once.
_RANGE = 1 << 15
_BEGINNINGS = (5, 6, 7, 8)
_TERM = stream(61, 256)[LOWER]
_AT = stream(62, 16) | np.uint64(1)
#: ASCII signs that are removed around a word.
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LOW = np.uint64((1 << SHINGLE_BITS) - 1)


def _bare(words: Words) -> Words:
    """The words without ASCII signs on either side, however many; words of signs alone become empty."""
    odd, n = _PUNCTUATION[words.data], np.arange(len(words.data))
    start = np.minimum(np.minimum.accumulate(np.where(odd, len(n), n)[::-1])[::-1][words.start], words.end)
    end = np.maximum(np.maximum.accumulate(np.where(odd, -1, n))[words.end - 1] + 1, start)
    return Words(words.data, start, end, words.first)


@dataclass
class Chosen:
    """Ascending hashes of 52 bits, looked up by a table of their first bits: they are spread evenly."""

    hashes: np.ndarray
    bits: int = 19

    @cached_property
    def _begin(self) -> np.ndarray:
        return np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(SHINGLE_BITS - self.bits)).astype(np.int32)

    @cached_property
    def _closed(self) -> np.ndarray:
        return np.append(self.hashes, _LOW + np.uint64(1))

    def places(self, f: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out, open_ = np.full(len(f), -1, dtype=np.int32), np.arange(len(f))
        at = self._begin[(f >> np.uint64(SHINGLE_BITS - self.bits)).astype(np.int64)]
        while len(open_):
            there, own = self._closed[at], f[open_]
            hit, more = there == own, there < own
            out[open_[hit]] = at[hit]
            open_, at = open_[more], at[more] + 1
        return out


def feature_counts(data: np.ndarray, off: np.ndarray, chosen: Chosen | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts data[off[i]:off[i + 1]] (at most MOST_DOCS): sorted (text, feature) pairs, their counts, words of each text.

    A feature is a hash of 52 bits. With chosen only its hashes are counted, and given by their place in it.
    """
    words = words_of(data, off)
    doc = words.doc.astype(np.uint64)
    n_words = words.counts
    if not len(doc):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, n_words
    bare = _bare(words)
    size = bare.end - bare.start
    parts, docs = [], []
    def take(h: np.ndarray, own: np.ndarray) -> None:
        parts.append(h & _LOW)
        docs.append(own)

    longest = len(words.data) - 1
    so_far = np.zeros(len(doc), dtype=np.uint64)
    for i in range(max(_BEGINNINGS)):
        so_far = so_far + _TERM[bare.data[np.minimum(bare.start + i, longest)]] * _AT[i]
        if i + 1 in _BEGINNINGS:
            own = size > i + 1
            take(mix(so_far[own] + np.uint64(i + 1)), doc[own])
    full = size > 0
    whole = Words(bare.data, bare.start[full], bare.end[full], bare.first)
    take(_whole_hashes(whole), doc[full])
    key = np.concatenate(docs) << np.uint64(SHINGLE_BITS) | np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    doc, f, counts = (key[first] >> np.uint64(SHINGLE_BITS)).astype(np.int64), key[first] & _LOW, np.diff(np.append(first, len(key)))
    if chosen is not None:
        place = chosen.places(f)
        hit = place >= 0
        doc, f, counts = doc[hit], place[hit].astype(np.uint64), counts[hit]
    return doc, f, counts, n_words


def _whole_hashes(words: Words) -> np.ndarray:
    """Hashes of bare words; what stands between two of them does not count."""
    if not len(words.start):
        return np.zeros(0, dtype=np.uint64)
    n = words.end - words.start
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    v = _TERM[words.data[at + np.repeat(words.start, n)]] * (mix((at >> 4).astype(np.uint64) + np.uint64(1)) * _AT[at & 15] | np.uint64(1))
    return mix(np.add.reduceat(v, np.cumsum(n) - n) ^ np.uint64(0x5EED))


def _near_length(n_words: int) -> int:
    """Lengths within a factor of two are taken as one."""
    return 2 ** round(np.log2(2 + n_words)) - 2


@dataclass
class Index:
    """Distinct example vectors, by feature and block; see the module's text."""

    chosen: np.ndarray  # sorted hashes of features
    idf: np.ndarray  # of each feature, times its label weight
    votes: np.ndarray  # of each example: weight of label 0 and of label 1, together log2(1 + rows that it stands for)
    witness: np.ndarray  # of each example: the smallest id that has its vector
    length: np.ndarray  # of each example: its entry for the length
    row: np.ndarray  # postings by (feature, block): where each pair's begin, examples and weights
    example: np.ndarray
    weight: np.ndarray
    ceiling: np.ndarray  # feature x block: the largest weight
    share: float
    length_weight: float = 0.5

    def __post_init__(self):
        n, blocks = len(self.votes), -(-len(self.votes) // BLOCK)
        #: what is nearest among examples that share no feature with a query
        self.bare = np.lexsort((np.arange(n), -self.length))
        #: of each example: the norm of its features' weights
        self.norm = np.zeros(n)
        for i in range(0, len(self.example), 1 << 18):
            own = slice(i, i + (1 << 18))
            self.norm += np.bincount(self.example[own], np.square(self.weight[own], dtype=np.float64), n)
        self.norm = np.sqrt(self.norm) * (1 + 1e-9)
        self.longest, self.steepest = (np.array([x[i * BLOCK : (i + 1) * BLOCK].max() for i in range(blocks)]) for x in (self.length, self.norm))

    @cached_property
    def known(self) -> Chosen:
        return Chosen(self.chosen)

    @cached_property
    def _query(self) -> np.ndarray:
        return np.zeros(len(self.chosen), dtype=np.float32)

    @cached_property
    def _own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each example's features begin, these and their weights: made by the workers, which spares sending them."""
        order = np.argsort(self.example, kind="stable").astype(np.int32)
        feature = np.repeat(np.repeat(np.arange(len(self.chosen), dtype=np.int32), self.ceiling.shape[1]), np.diff(self.row))
        return np.append(0, np.cumsum(np.bincount(self.example, minlength=len(self.votes)))), feature[order], self.weight[order]

    def vector(self, features: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, float]:
        """The unit vector of one document: weights of its features, and its entry for the length."""
        w = np.append((1 + np.log(counts)) * self.idf[features], self.length_weight * np.log2(2 + _near_length(n_words)))
        w /= np.sqrt((w * w).sum())
        return w[:-1], float(w[-1])

    def nearest(self, features: np.ndarray, weights: np.ndarray, length: float, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine, ties by their number; exact.

        Postings are read for the heaviest features alone. What all lighter ones can add to an example is at most the product
        of their norm and the example's own, and is computed for those examples that it may bring among the best.
        """
        i = self.bare[:k]
        if not len(features):
            return length * self.length[i], i
        order = np.argsort(-weights, kind="stable")
        features, weights = features[order], weights[order]
        left = np.sqrt(np.cumsum((weights * weights)[::-1])[::-1])
        m = int(np.searchsorted(-left, -_LIGHT))
        rest = float(left[m]) if m < len(left) else 0.0
        bound = weights[:m] @ self.ceiling[features[:m]] + rest * self.steepest + length * self.longest
        order = np.argsort(-bound, kind="stable")
        # the first block gives a k-th best; then all others that may hold a better one are visited at once
        i, s = self._visit(features[:m], weights[:m], length, order[:1])
        more = order[1:]
        if len(i) >= k:
            more = more[bound[more] >= np.partition(s, len(s) - k)[len(s) - k] - 1e-12]
        if len(more):
            i, s = (np.concatenate(x) for x in zip((i, s), self._visit(features[:m], weights[:m], length, more)))
        if len(i) > k:
            near = s + rest * self.norm[i] >= np.partition(s, len(s) - k)[len(s) - k] - 1e-12
            i, s = i[near], s[near]
        s = s + self._light(features[m:], weights[m:], i)
        top = np.lexsort((i, -s))[:k]
        return s[top], i[top]

    def _visit(self, features: np.ndarray, weights: np.ndarray, length: float, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All examples of some blocks, with their cosines as far as these features and the length give them."""
        width = self.ceiling.shape[1]
        if 2 * len(blocks) > width:  # one run of postings for each feature is read faster than many short ones
            lo, hi = self.row[features * width], self.row[(features + 1) * width]
        else:
            cell = (features[:, None] * width + blocks[None, :]).ravel()
            lo, hi, weights = self.row[cell], self.row[cell + 1], np.repeat(weights, len(blocks))
        size = (hi - lo).astype(np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
        dot = np.bincount(self.example[at], np.repeat(weights, size) * self.weight[at], len(self.votes))
        i = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        i = i[i < len(self.votes)]
        return i, dot[i] + length * self.length[i]

    def _light(self, features: np.ndarray, weights: np.ndarray, i: np.ndarray) -> np.ndarray:
        """What some features add to the cosines of some examples."""
        if not len(features):
            return np.zeros(len(i))
        first, feature, weight = self._own
        self._query[features] = weights
        size = first[i + 1] - first[i]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(begin - first[i], size)
        dot = np.zeros(len(i))
        some = size > 0
        if some.any():
            dot[some] = np.add.reduceat(self._query[feature[at]] * weight[at], begin[some])
        self._query[features] = 0
        return dot

    def score(self, features: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[float, int | None, float]:
        """Share of label 1 among weighted votes, the nearest example's id, and its cosine.

        A vote grows slowly with the labelled rows behind an example, and falls steeply with its distance; the sample's share of
        label 1 takes part as one weak vote, so that the score is near it where nothing is near.
        """
        if not len(self.votes):
            return self.share, None, 0.0
        s, i = self.nearest(features, *self.vector(features, counts, n_words))
        pull = np.exp(-8 * (1 - np.minimum(s, 1.0)))[:, None] * self.votes[i]
        zero, one = pull.sum(axis=0)
        return float((one + 0.05 * self.share) / (zero + one + 0.05)), int(self.witness[i[0]]), float(s[0])


def build_index(docs: Iterable[tuple[int, np.ndarray, np.ndarray, int]], label: np.ndarray, row_weight: np.ndarray, chosen: np.ndarray, idf: np.ndarray, share: float) -> Index:
    """An index of examples (id, places of features, counts, words) with their labels and the rows that each stands for."""
    plain = Index(chosen, idf, np.zeros((0, 2)), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((len(chosen), 0)), share)
    merged: dict[tuple, list] = {}
    docs = iter(docs)
    for (doc, f, c, n), y, w in zip(docs, label, row_weight):
        v, size = plain.vector(f, c, n)
        f, v = f.astype(np.int32, copy=False), v.astype(np.float32)
        own = merged.setdefault(blake2b(f.tobytes() + np.round(v, 6).tobytes(), digest_size=16).digest(), [doc, f, v, size, np.zeros(2)])
        own[0] = min(own[0], doc)
        own[4][int(y)] += w
    # neighbours in this order share their heaviest features, which makes the blocks' bounds tight
    own = [merged[k] for k in sorted(merged, key=lambda k: (merged[k][1][np.argsort(-merged[k][2], kind="stable")[:8]].tolist(), k))]
    blocks = -(-len(own) // BLOCK)
    if not own:
        return plain
    # little beside the index itself is held at once: what has the size of all postings is given up as soon as it is used
    first = np.append(0, np.cumsum([len(x[1]) for x in own]))
    feature, flat = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own])
    rows, witness, length = np.array([x[4] for x in own]), np.array([x[0] for x in own]), np.array([x[3] for x in own])
    del docs, merged, own
    common.release()
    row = np.zeros(len(chosen) * blocks + 1, dtype=np.int32 if len(flat) < 2**31 else np.int64)
    ceiling = np.zeros((len(chosen), blocks), dtype=np.float32)
    example, weight, done = np.empty(len(flat), dtype=np.int32), np.empty(len(flat), dtype=np.float32), 0
    for lo in range(0, len(chosen), _RANGE):
        n = min(_RANGE, len(chosen) - lo)
        at = np.flatnonzero((feature >= lo) & (feature < lo + n))
        at = at[np.argsort(feature[at], kind="stable")]
        i, w = np.searchsorted(first, at, "right") - 1, flat[at]
        cell = (feature[at].astype(np.int64) - lo) * blocks + i // BLOCK
        row[lo * blocks + 1 : (lo + n) * blocks + 1] = done + np.cumsum(np.bincount(cell, minlength=n * blocks))
        np.maximum.at(ceiling[lo : lo + n].reshape(-1), cell, w)
        example[done : done + len(at)], weight[done : done + len(at)] = i, w
        done += len(at)
    del feature, flat
    votes = rows * (np.log2(1 + rows.sum(axis=1)) / rows.sum(axis=1))[:, None]
    return Index(chosen, idf, votes, witness, length, row, example, weight, ceiling, share)


def label_weight(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of features that a of n1 texts of label 1 and b of n0 of label 0 have: the square of their log odds between the labels,
    times c^2 / (c^2 + 4.5^2) with c its chi-square. No feature is left out: the chi-square only tells how far its odds are to be believed.
    """
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    n = n1 + n0
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * float(n1 * n0), 1e-9)
    return odds**2 * chi2**2 / (chi2**2 + 4.5**2)


def document_frequencies(docs: DataFrame, chosen: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each chosen feature: over all of docs (text), counted inside tasks.

    To the driver comes a row for each chosen feature at most.
    """
    held = docs.sparkSession.sparkContext.broadcast(Chosen(chosen))

    @common.thrifty
    def run(batches):
        n = np.zeros(len(held.value.hashes) + 1, dtype=np.int64)
        for b in batches:
            data, off = text_buffer(b.column("text"))
            n[-1] += len(off) - 1
            for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS):
                f = feature_counts(data, off[lo : hi + 1], held.value)[1]
                n[:-1] += np.bincount(f.astype(np.int64), minlength=len(n) - 1)
        found = np.flatnonzero(n)
        for i in range(0, len(found), 1 << 16):
            own = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own])], names=["f", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    out = np.zeros(len(chosen) + 1, dtype=np.int64)
    out[rows.column("f").to_numpy()] = rows.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index:
    """An index from (doc_id, text) and (doc_id, toxic); at most sample labelled rows of each label, weighted to stand for all.

    It holds every feature of the sampled texts; its size is theirs. How many documents have each is counted over all of docs.
    """
    common.small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    label = {r.doc_id: r.y for x in picked for r in x.collect()}  # at most 2 * sample rows
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    none = np.zeros(0, dtype=np.uint64)
    if not label:
        return build_index([], np.zeros(0), np.zeros(0), none, np.zeros(0), share)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in label], "doc_id long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id", "left_semi")

    @common.thrifty
    def run(batches):
        for b in batches:
            data, off = text_buffer(b.column("text"))
            ids = b.column("doc_id")
            for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS):
                doc, f, c, n = feature_counts(data, off[lo : hi + 1])
                size = np.bincount(doc, minlength=hi - lo)
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False), n, size)]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([pack(x)], pa.binary()) for x in (np.diff(f, prepend=np.uint64(0)), c))], names=["doc_id", "n", "size", "f", "c"])

    rows = texts.mapInArrow(run, "doc_id array<long>, n array<long>, size array<long>, f binary, c binary").toArrow()  # at most 2 * sample texts
    ids, words, size = (np.array([v for x in rows.column(k).to_pylist() for v in x], dtype=np.int64) for k in ("doc_id", "n", "size"))
    first = np.append(0, np.cumsum(size))
    hashes, counts, at = np.empty(first[-1], dtype=np.uint64), np.empty(first[-1], dtype=np.int32), 0
    for f, c in zip(rows.column("f"), rows.column("c")):
        f, c = np.cumsum(unpack(f.as_py()), dtype=np.uint64), unpack(c.as_py())
        hashes[at : at + len(f)], counts[at : at + len(f)] = f, c
        at += len(f)
    y = np.array([label[i] for i in ids.tolist()], dtype=np.int64)
    chosen, place = np.unique(hashes), np.empty(len(hashes), dtype=np.int32)
    a, b = np.zeros(len(chosen), dtype=np.int64), np.zeros(len(chosen), dtype=np.int64)
    for i, own in enumerate(y):  # text by text: nothing else of the size of all postings
        at = slice(first[i], first[i + 1])
        place[at] = np.searchsorted(chosen, hashes[at])
        (a if own else b)[place[at]] += 1
    del rows, hashes
    common.release()
    weight = np.array([totals.get(x, 0) / max(1, sum(v == x for v in label.values())) for x in (0, 1)])
    n, df = document_frequencies(docs, chosen)
    idf = np.log((1 + n) / (1 + df)) * label_weight(a, b, int(y.sum()), int((1 - y).sum()))
    order = np.lexsort((words, ids))
    examples = _examples(order, ids, first, place, counts, words)
    del place, counts, a, b, df
    index = build_index(examples, y[order], weight[y[order]], chosen, idf, share)
    common.release()
    return index


def _examples(order: np.ndarray, ids: np.ndarray, first: np.ndarray, place: np.ndarray, counts: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Each example's id, places of features, counts and words. Lets go of the arrays at its end."""
    for i in order:
        yield int(ids[i]), place[first[i] : first[i + 1]], counts[first[i] : first[i + 1]], int(words[i])


#: Scores that a worker remembers, by 128 bits of what they are made from: exact copies are scored once.
_REMEMBERED = 200_000


def _scores(index: Index, data: np.ndarray, off: np.ndarray, memo: dict) -> list[tuple[float, int | None, float]]:
    doc, f, c, n_words = feature_counts(data, off, index.known)
    first = np.searchsorted(doc, np.arange(len(n_words) + 1))
    f = f.astype(np.int64)
    out = []
    for i, n in enumerate(n_words):
        lo, hi = first[i], first[i + 1]
        # without features, documents differ by their length alone, which leaves their unit vector the same
        key = blake2b(f[lo:hi].tobytes() + c[lo:hi].tobytes() + bytes([_near_length(int(n)).bit_length() if hi > lo else 0]), digest_size=16).digest()
        if key not in memo:
            if len(memo) >= _REMEMBERED:
                memo.clear()
            memo[key] = index.score(f[lo:hi], c[lo:hi].astype(np.float64), int(n))
        out.append(memo[key])
    return out


def score_documents(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), nearest (an example's id: the evidence) and cosine: one row for each input row.

    Null and empty texts are scored as texts without any known feature; null ids stay null; other columns are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)

    @common.thrifty
    def run(batches):
        memo: dict = {}
        for b in batches:
            data, off = text_buffer(b.column("text"))
            for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS):
                s, near, cosine = zip(*_scores(held.value, data, off[lo : hi + 1], memo))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(s, pa.float64()), pa.array(near, pa.int64()), pa.array(cosine, pa.float64())], names=["doc_id", "score", "nearest", "cosine"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, score double, nearest long, cosine double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as the text of no digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_clean(docs: DataFrame, labels: DataFrame, reject: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below reject, with all their columns."""
    index = learn(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        data, off = text_buffer(texts)
        memo: dict = {}
        scores = [_scores(held.value, data, off[lo : hi + 1], memo) for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS)]
        common.release()
        return pa.array([s < reject for own in scores for s, _, _ in own], pa.bool_())

    return docs.where(clean(F.coalesce(F.col(text_col), F.lit(""))))


def op8_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of held-out rows are not learned from."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    index = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score_documents(docs, index)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest", "cosine")
