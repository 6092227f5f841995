"""Log-bilinear language model, trained in numpy by noise-contrastive estimation, and corpus-wide unigram scores.

Output symbols are the most frequent words, the end of a text, and classes of all other words (by their first two bytes);
a word of a class is told by its add-one frequency there, so probabilities add up to one over all words, unseen ones
included. The context is the symbol before and the coarse class of the one before that: each is embedded, multiplied by the
matrix of its position, and the sum is matched with every symbol's vector (log-bilinear). How often each symbol follows each
context is counted over all training texts, which gives both terms of the noise-contrastive objective exactly. For scoring,
one batched matrix product over all contexts and a softmax give normalised log-probabilities.

That model is what a word's own context backs off to. Contexts themselves are all words of the corpus, and grow with it: how
often each word follows each other one is counted, and a word's probability is (its count after the word before + weight * the
model's) / (the word before's count c + weight), a prior whose weight is c ** HEAPS, about the number of different words that
follow (Witten-Bell's weight, by Heaps' law). It adds up to one over all words.

Counts of all words and pairs stay distributed. Blocks of texts send the distinct hashes that they hold, in ascending order and
packed, with their counts to the tasks of the hashes' ranges; these add up, and send back the totals in the same order. A word
that is everywhere is one entry of each block's message, so no hash is a hot key. Words and pairs are told apart by 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import LOWER, Words, mix, pack, row_ranges, text_buffer, unpack, words_of

#: Frequent words with a symbol of their own, classes of the others, coarse classes of the symbol before last.
FREQUENT, CLASSES, COARSE = 448, 64, 8
SYMBOLS = FREQUENT + CLASSES + 1
END = SYMBOLS - 1
#: The hash that stands for the end of a text; no word has it but by chance.
END_HASH = np.uint64(0x5EED0FE11D)
_SLICE_BYTES = 1 << 18
_MERGE = 1 << 22
#: After a word that is found c times the model weighs as much as c to this power: about as many different words follow it.
HEAPS = 0.9


@dataclass(frozen=True)
class Training:
    width: int = 24
    noise: int = 8
    steps: int = 90
    rate: float = 0.06
    seed: int = 7


def word_class(words: Words) -> np.ndarray:
    """The class of each word: a hash of its first two bytes (A-Z lowered)."""
    b = LOWER[words.data]
    first = b[words.start].astype(np.uint64)
    second = np.where(words.end - words.start > 1, b[np.minimum(words.start + 1, len(b) - 1)], 0).astype(np.uint64)
    return (mix(first << np.uint64(8) | second) % np.uint64(CLASSES)).astype(np.int64)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all words and ends of consecutive texts, and where each text's tokens begin (one more)."""
    words = words_of(data, off)
    n = len(off) - 1
    at = words.first + np.arange(n + 1)
    h, c = np.full(at[-1], END_HASH, dtype=np.uint64), np.full(at[-1], -1, dtype=np.int64)
    if len(words.start):
        place = np.arange(len(words.start)) + words.doc
        h[place], c[place] = words.hashes(), word_class(words)
    return h, c, at


@dataclass
class Vocabulary:
    """Hashes of the frequent words in ascending order; their symbols are their places."""

    frequent: np.ndarray
    coarse: np.ndarray  # of each symbol

    def symbols(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.where(c < 0, END, FREQUENT + c)
        if len(self.frequent):
            low = np.uint64((1 << 16) - 1)
            near = np.zeros(1 << 16, dtype=bool)
            near[(self.frequent & low).astype(np.int64)] = True
            maybe = np.flatnonzero(near[(h & low).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.frequent, h[maybe]), len(self.frequent) - 1)
            hit = (self.frequent[place] == h[maybe]) & (c[maybe] >= 0)
            out[maybe[hit]] = place[hit]
        return out

    def contexts(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each token the number of its context; before a text stand two ends."""
        before, last = np.empty_like(symbol), np.empty_like(symbol)
        before[1:], last[2:] = symbol[:-1], symbol[:-2]
        starts = at[:-1]
        before[starts], last[starts] = END, END
        second = starts[np.diff(at) > 1] + 1
        last[second] = END
        return self.coarse[last] * SYMBOLS + before


def train(cells: np.ndarray, params: Training = Training()) -> np.ndarray:
    """Normalised natural log-probabilities, contexts x symbols, of the model fitted to cells (contexts x symbols counts).

    The objective for context c and symbol w with d = s(c, w) - log(k q(w)), q the noise (smoothed frequencies):
    sum of n(c, w) log sigmoid(d) + k n(c) q(w) log sigmoid(-d). Full-batch steps with Adam.
    """
    contexts, symbols = cells.shape
    rng = np.random.default_rng(params.seed)
    total = max(1.0, float(cells.sum()))
    q = (cells.sum(axis=0) + 0.5) / (total + 0.5 * symbols)
    d = params.width
    near, far = np.arange(contexts) % symbols, np.arange(contexts) // symbols
    p = {
        "word": rng.normal(0, 0.1, (symbols, d)),
        "group": rng.normal(0, 0.1, (contexts // symbols, d)),
        "at1": np.eye(d) + rng.normal(0, 0.01, (d, d)),
        "at2": np.eye(d) + rng.normal(0, 0.01, (d, d)),
        "out": rng.normal(0, 0.1, (symbols, d)),
        "bias": np.log(q),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    live = np.flatnonzero(cells.sum(axis=1) > 0)
    n = (cells[live] / total).astype(np.float32)
    noise = (params.noise * n.sum(axis=1, keepdims=True) * q[None, :]).astype(np.float32)
    shift = np.log(params.noise * q).astype(np.float32)
    near, far = near[live], far[live]
    for step in range(1, params.steps + 1 if len(live) else 1):
        w1, g2 = p["word"] @ p["at1"], p["group"] @ p["at2"]
        u = w1[near] + g2[far]
        s = u @ p["out"].T + (p["bias"] - shift)
        sig = 1 / (1 + np.exp(-s))
        e = n * (1 - sig) - noise * sig  # the objective's derivative by the score
        du = e @ p["out"]
        dw, dg = np.zeros_like(w1), np.zeros_like(g2)
        np.add.at(dw, near, du)
        np.add.at(dg, far, du)
        grad = {"out": e.T @ u, "bias": e.sum(axis=0), "word": dw @ p["at1"].T, "at1": p["word"].T @ dw, "group": dg @ p["at2"].T, "at2": p["group"].T @ dg}
        rate = params.rate * (1 - 0.9 * step / params.steps)
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    near, far = np.arange(contexts) % symbols, np.arange(contexts) // symbols
    s = ((p["word"] @ p["at1"])[near] + (p["group"] @ p["at2"])[far]) @ p["out"].T + p["bias"]
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id counts as the text of no digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _texts(b: pa.RecordBatch):
    data, off = text_buffer(b.column("text"))
    for lo, hi in row_ranges(off, _SLICE_BYTES, 1 << 16):
        yield lo, hi, *tokens(data, off[lo : hi + 1])


def _merged(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, c[first], np.bincount(inverse, n, len(u)).astype(np.int64)


def pairs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the hash of what stands before it (the end, at the beginning of a text), and that of the two."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = END_HASH
    return before, mix(mix(before ^ np.uint64(0xB16A)) + h)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and how often each is there. Sorts without an order of places, which is faster."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def distinct_hashes(group: pa.Table, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of words and pairs in a block of texts, ascending, and their counts in those that are learned from
    (zeros if they are not counted)."""
    held, own = [], [np.zeros(0, dtype=np.uint64)]
    for b in group.to_batches():
        learned = b.column("learned").to_numpy(zero_copy_only=False)
        for lo, hi, h, _, at in _texts(b):
            x = np.stack([h, pairs(h, at)[1]])
            held.append(x.ravel())
            if counted:
                own.append(x[:, np.repeat(learned[lo:hi], np.diff(at))].ravel())
    u = _distinct(np.concatenate(held))[0]
    n = np.zeros(len(u), dtype=np.uint64)
    known, count = _distinct(np.concatenate(own))
    n[np.searchsorted(u, known)] = count
    return u, n


class Places:
    """Finds hashes among ascending ones that hold them all, by a table of their first bits: they are spread evenly."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.begin = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.begin[(h >> self.shift).astype(np.int64)]
        open_ = np.flatnonzero(self.hashes[at] != h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.hashes[at[open_]] != h[open_]]
        return at


def _ask(ranges: int):
    """A block's message to each range of hashes."""
    floors = (np.arange(ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges) << np.uint64(32)

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        u, n = distinct_hashes(group)
        at = np.append(np.searchsorted(u, floors), len(u))
        own = np.flatnonzero(np.diff(at))
        keys = [pack(np.diff(u[at[r] : at[r + 1]], prepend=floors[r])) for r in own]
        counts = [pack(n[at[r] : at[r + 1]]) for r in own]
        common.release()
        return pa.table({"range": pa.array(own.astype(np.int32)), "block": pa.array(np.full(len(own), block, dtype=np.int32)), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _answer(group: pa.Table) -> pa.Table:
    """The totals of one range of hashes, for each block in the order of its message."""
    own = [np.cumsum(unpack(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
    u = _distinct(np.concatenate(own))[0]
    places, total = [np.searchsorted(u, x).astype(np.int32) for x in own], np.zeros(len(u), dtype=np.uint64)
    for at, c in zip(places, group.column("counts").to_pylist()):
        total[at] += unpack(c)
    counts = [pack(total[at]) for at in places]
    common.release()
    return pa.table({"block": group.column("block"), "range": group.column("range"), "counts": pa.array(counts, pa.binary())})


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, cls, c): hash, class (-1: the end) and count of every distinct token of (text); counted first inside tasks."""

    @common.thrifty
    def run(batches):
        held, size = [], 0

        def merged():
            return _merged(*(np.concatenate(x) for x in zip(*held)))

        for b in batches:
            for _, _, h, c, _ in _texts(b):
                own = _merged(h, c, np.ones(len(h)))
                held.append(own)
                size += len(own[0])
                if size > _MERGE:
                    held = [merged()]
                    if len(held[0][0]) > _MERGE // 2:
                        yield from _count_batches(*held[0])
                        held = []
                    size = sum(len(x[0]) for x in held)
        if held:
            yield from _count_batches(*merged())

    parts = docs.select("text").mapInArrow(run, "h long, cls int, c long")
    return parts.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


def _count_batches(h, c, n):
    for i in range(0, len(h), 1 << 16):
        s = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(c[s].astype(np.int32)), pa.array(n[s])], names=["h", "cls", "c"])


@dataclass
class Model:
    """What scoring needs beside the counts of words and pairs: what these back off to, the same size for any corpus.

    cells: the training tokens of the context table, each of which is one of n.
    """

    vocabulary: Vocabulary
    log10: np.ndarray  # contexts x symbols
    class_total: np.ndarray  # of each class: tokens + distinct words + 1
    n: int
    v: int
    cells: int


def fit(docs: DataFrame, counts: DataFrame, params: Training = Training()) -> Model:
    """Vocabulary, context table and model from all texts of docs (text), whose counts are given."""
    spark = docs.sparkSession
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = sorted(((r.h & (2**64 - 1), r.cls) for r in counts.where("cls >= 0").orderBy(F.desc("c"), "h").limit(FREQUENT).collect()))
    frequent = np.array([h for h, _ in top], dtype=np.uint64)
    coarse = np.zeros(SYMBOLS, dtype=np.int64)
    coarse[: len(top)] = [c % COARSE for _, c in top]
    coarse[FREQUENT:END] = np.arange(CLASSES) % COARSE
    coarse[END] = COARSE - 1
    vocabulary = Vocabulary(frequent, coarse)
    held = spark.sparkContext.broadcast(vocabulary)
    names = F.broadcast(spark.createDataFrame([(int(np.array(h, dtype=np.uint64).view(np.int64)),) for h, _ in top], "h long"))
    rest = counts.where("cls >= 0").join(names, "h", "left_anti").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_total = np.ones(CLASSES)
    for r in rest:
        class_total[r.cls] += r.n + r.v

    @common.thrifty
    def run(batches):
        cells = np.zeros(COARSE * SYMBOLS * SYMBOLS, dtype=np.int64)
        for b in batches:
            for _, _, h, c, at in _texts(b):
                s = held.value.symbols(h, c)
                cells += np.bincount(held.value.contexts(s, at) * SYMBOLS + s, minlength=len(cells))
        used = np.flatnonzero(cells)
        for i in range(0, len(used), 1 << 16):
            own = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(cells[own])], names=["cell", "n"])

    table = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most COARSE * SYMBOLS^2 rows
    cells = np.zeros(COARSE * SYMBOLS * SYMBOLS)
    cells[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    log10 = train(cells.reshape(-1, SYMBOLS), params) / np.float32(np.log(10))
    return Model(vocabulary, log10, class_total, int(total.n or 0), int(total.v or 0), int(cells.sum()))


def with_prior(pair: np.ndarray, before: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Probabilities by counts of a pair and of its first token; the model's after new ones."""
    weight = np.where(before > 0, np.maximum(before, 1) ** HEAPS, 1.0)
    return (pair + weight * model) / (before + weight)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 2_500_000, params: Training = Training()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    Learns from all rows that are not held out. Null text counts as empty (one token, the end), null ids as the text of no
    digits; repeated rows are each learned from and scored; other columns are dropped. Without training texts base_score
    and what classes add are those of empty counts, and score comes from an untrained model. Blocks hold about block_tokens
    tokens, or one longer text.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("learned", ~held_out(F.col("doc_id")))
    learned = d.where("learned")
    counts = common.stored(word_counts(learned), "counts")
    model = fit(learned, counts, params)
    held = spark.sparkContext.broadcast(model)
    # a seventh of all texts is held out
    blocks = max(common.blocks_for(model.n * 7 // 6, block_tokens), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = held.value
        names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not len(group):
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        h0 = distinct_hashes(group, counted=False)[0]
        place = Places(h0)
        order = np.argsort(known.column("range").to_numpy())
        answers = known.column("counts").to_pylist()
        c0 = np.concatenate([unpack(answers[i]) for i in order]).astype(np.int64)
        end = c0[np.searchsorted(h0, END_HASH)]
        ids, out = [], []
        for b in group.to_batches():
            for lo, hi, h, c, at in _texts(b):
                n = c0[place(h)]
                symbol = m.vocabulary.symbols(h, c)
                lp = m.log10[m.vocabulary.contexts(symbol, at), symbol].astype(np.float64)
                tail = np.flatnonzero((symbol >= FREQUENT) & (symbol < END))
                lp[tail] += np.log10((n[tail] + 1) / m.class_total[symbol[tail] - FREQUENT])
                before = np.append(end, n[:-1])
                before[at[:-1]] = end
                lp = np.log10(with_prior(c0[place(pairs(h, at)[1])], before, 10**lp))
                base = np.log10((n + 1) / (m.n + 1 * (m.v + 1)))
                ids.append(b.column("doc_id").slice(lo, hi - lo))
                out.append(np.stack([np.diff(at), np.add.reduceat(n > 0, at[:-1], dtype=np.int64), np.add.reduceat(base, at[:-1]), np.add.reduceat(lp, at[:-1])]))
        n_tokens, n_known, base, lp = np.concatenate(out, axis=1)
        common.release()
        return pa.table([pa.chunked_array(ids, pa.int64()), *(pa.array(x, t) for x, t in zip((n_tokens.astype(np.int64), n_known.astype(np.int64), base, lp), list(names.values())[1:]))], names=list(names))

    asked = dealt.groupBy("block").applyInArrow(_ask(blocks), "range int, block int, keys binary, counts binary")
    answered = asked.repartition(blocks, "range").groupBy("range").applyInArrow(_answer, "block int, range int, counts binary")
    out = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a model that learned from those not held out."""
    return score_documents(common.table(spark, sf_dir, "documents"))
