"""Exact removal of long repeated passages by a logarithmic family of suffix arrays.

Every byte covered by a string of `length` bytes that also starts anywhere else is removed. Such strings are called windows.

Dealing out. The smallest hash among a window's grams of GRAM bytes is its anchor: equal windows have equal anchors, so all
occurrences of a window lie in segments (maximal runs of windows of one text with one anchor) of one anchor, and each anchor
is a matter of its own. Segments whose anchor is found once cannot repeat. Equal segments repeat as a whole, which counts
decide. What is left are anchors with different segments: one text of each goes to the anchor's task.

The index. A task adds these in batches to a family of suffix arrays over their windows (in byte order, by prefix doubling
up to `length` bytes). A new batch gets a suffix array, whose equal neighbours are matches; it is scanned against the levels
held for matches with these; then levels of similar size merge by putting the smaller one's windows where they stand in the
larger one's order, so that there are logarithmically many. Anchors of very many segments are dealt out by further anchors, and
equal parts are counted once more, so that a passage that many different segments share enters an index once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .textvec import mix, row_ranges, stream, text_buffer

LENGTH, GRAM = 200, 32
#: Text of one block, of one batch of the index, and segments of one anchor from which they are dealt out further.
BLOCK_BYTES, BATCH_BYTES, HOT = 8 << 20, 2 << 20, 400
_SLICE_BYTES = 1 << 18
_BYTE = stream(71, 256)
_P = int(stream(72, 1)[0]) | 1
_SPLITS = 3


def gram_hashes(b: np.ndarray, size: int = GRAM, seed: int = 0) -> np.ndarray:
    """Hashes of all substrings of size bytes (a power of two), by doubling."""
    h, k, p = _BYTE[b], 1, _P
    while k < size:
        h = h[:-k] * np.uint64(p) + h[k:]
        k, p = 2 * k, p * p & (2**64 - 1)
    return mix(h ^ np.uint64(seed))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each width consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Segments:
    """Of each segment: text, first window (in that text), windows, anchor, name of its content, whether its anchor's gram
    occurs in it more than once (only then may one of its windows equal another)."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    name: np.ndarray
    again: np.ndarray


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Segments:
    """The segments of texts data[off[i]:off[i + 1]]; texts shorter than length have none."""
    lo = int(off[0])
    b, off = data[lo : int(off[-1])], off - lo
    width = length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if len(b) < length:
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool))
    h = gram_hashes(b, gram)
    low = sliding_min(h, width)
    n = np.maximum(np.diff(off) - length + 1, 0)
    # windows that lie in one text: the start of each text's, and how many
    valid = np.zeros(len(low) + 1, dtype=np.int8)
    np.add.at(valid, off[:-1][n > 0], 1)
    np.add.at(valid, (off[:-1] + n)[n > 0], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    begins = valid.copy()
    begins[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    begins[off[:-1][n > 0]] = True
    start = np.flatnonzero(begins)
    count = np.diff(np.append(np.cumsum(valid)[start], valid.sum() + 1)) if len(start) else none
    doc = np.searchsorted(off, start, side="right") - 1
    anchor = low[start]
    m = mix(h + np.uint64(0x2545F491))
    plain = np.concatenate([[np.uint64(0)], np.cumsum(m)])
    weighed = np.concatenate([[np.uint64(0)], np.cumsum(m * np.arange(1, len(m) + 1, dtype=np.uint64))])
    end = start + count + width - 1
    total = plain[end] - plain[start]
    moment = weighed[end] - weighed[start] - total * start.astype(np.uint64)
    name = mix(mix(total + count.astype(np.uint64)) ^ (moment * np.uint64(_P)))
    again = np.zeros(len(start), dtype=bool)
    for i in range(0, len(start), 4096):
        s, c = start[i : i + 4096], count[i : i + 4096]
        first = (h[s[:, None] + np.arange(width)] == anchor[i : i + 4096, None]).argmax(axis=1) + s
        last_at = s + c - 1
        last = last_at + width - 1 - (h[last_at[:, None] + np.arange(width - 1, -1, -1)] == anchor[i : i + 4096, None]).argmax(axis=1)
        again[i : i + 4096] = first != last
    return Segments(doc, start - off[doc], count, anchor, name, again)


def split_segment(b: np.ndarray, windows: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Parts of one segment by the anchors of further hashes: (first window, windows, name); equal windows get equal names.

    This deals out an anchor that very many different segments share: a window's further anchors mostly lie in what
    differs between them.
    """
    names = np.zeros(windows, dtype=np.uint64)
    for i in range(_SPLITS):
        low = sliding_min(gram_hashes(b, 16, i + 1), length - 15)
        names = mix(names + low[:windows])
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return [(int(a), int(z - a), int(names[a].view(np.int64))) for a, z in zip(at, np.append(at[1:], windows))]


def _ranks(key: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones, as uint32; holds little beside key."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.zeros(len(key), dtype=np.uint32)
    np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint32, out=new[1:])
    out = np.empty(len(key), dtype=np.uint32)
    out[order] = new
    return out


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    key = high.astype(np.uint64)
    key <<= np.uint64(32)
    key |= low
    return key


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number whose order is that of the bytes; text ends with padding."""
    n = len(text) - 8
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | text[i : i + n]
    return out


@dataclass
class Level:
    """A suffix array: texts of segments one after the other, padded; window positions in byte order of their first length
    bytes; for each position its place in the caller's lists; and the first eight bytes everywhere."""

    text: np.ndarray
    order: np.ndarray
    owner: np.ndarray
    eight: np.ndarray


class SuffixFamily:
    """Levels of suffix arrays over windows; finds which windows of all batches added so far occur twice or more."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels, self.hit = length, [], np.zeros(0, dtype=bool)

    def add(self, text: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Adds windows text[p : p + length] for p in position; gives their numbers in hit."""
        number = np.arange(len(self.hit), len(self.hit) + len(position))
        self.hit = np.append(self.hit, np.zeros(len(position), dtype=bool))
        if not len(position):
            return number
        new = self._build(text, position, number)
        places = None
        for level in self.levels:
            places = self._scan(new, level)
        while self.levels and len(self.levels[-1].order) <= 2 * len(new.order):
            old = self.levels.pop()
            new = self._merge(old, new, self._places(new, old)[0] if places is None else places)
            places = None
        self.levels.append(new)
        return number

    def _build(self, text: np.ndarray, position: np.ndarray, owner: np.ndarray) -> Level:
        """Prefix doubling over all positions of text; then windows by the ranks of two overlapping halves."""
        padded = np.concatenate([text, np.zeros(self.length + 8, dtype=np.uint8)])
        eight = _eight(padded)
        rank = _ranks(eight)
        k = 8
        while 2 * k <= self.length:
            rank = _ranks(_pairs(rank[:-k], rank[k:]))
            k *= 2
        # the first k bytes, then the last k: where the first are equal, the last decide
        key = _pairs(rank[position], rank[position + self.length - k])
        at = np.argsort(key, kind="stable")
        key = key[at]
        same = np.flatnonzero(key[1:] == key[:-1])
        self.hit[owner[at[same]]] = True
        self.hit[owner[at[same + 1]]] = True
        return Level(padded, position[at], owner[at], eight)

    def _compare(self, a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as a's windows at i come before, equal or follow b's at j."""
        out = np.zeros(len(i), dtype=np.int8)
        open_ = np.arange(len(i))
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            x, y = a.eight[i[open_] + k], b.eight[j[open_] + k]
            differ = x != y
            out[open_[differ]] = np.where(x[differ] < y[differ], -1, 1)
            open_ = open_[~differ]
            if not len(open_):
                break
        return out

    def _places(self, new: Level, old: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each of new's windows in order: its place in old's order, and the end of those with its first eight bytes."""
        head = old.eight[old.order]
        key = new.eight[new.order]
        lo, ends = np.searchsorted(head, key, side="left"), np.searchsorted(head, key, side="right")
        hi = ends.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            before = self._compare(old, old.order[mid], new, new.order[open_]) < 0
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, ends

    def _scan(self, new: Level, old: Level) -> np.ndarray:
        """Marks windows that are in both, and gives the places of new's in old's order."""
        lo, ends = self._places(new, old)
        maybe = np.flatnonzero(lo < ends)
        found = maybe[self._compare(old, old.order[lo[maybe]], new, new.order[maybe]) == 0]
        self.hit[new.owner[found]] = True
        # equal windows of one old array are marked already; one that stood alone is at the place found
        self.hit[old.owner[lo[found]]] = True
        return lo

    def _merge(self, old: Level, new: Level, places: np.ndarray) -> Level:
        """One level of both: the orders are merged, nothing is sorted anew."""
        order, owner = np.insert(old.order, places, new.order + len(old.text)), np.insert(old.owner, places, new.owner)
        return Level(np.concatenate([old.text, new.text]), order, owner, np.concatenate([old.eight, np.zeros(8, dtype=np.uint64), new.eight]))


def _rows(group: pa.Table) -> pa.Table:
    """A block's rows in an order of their own, whatever the order they came in."""
    group = group.combine_chunks()
    return group.take(pa.array(np.lexsort((group.column("sort_b").to_numpy(), group.column("sort_a").to_numpy()))))


def _buffer(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = group.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    return text_buffer(column)


#: A segment's place is the name of its row (a 64-bit hash of all of it; equal rows share one, and all their segments occur
#: as often as they do); its span: first window above 28 bits of windows, then one bit.
_ASK = "anchor long, name long, place long, span long"
_WINDOW_BITS = 28


def _ask(length: int):
    @common.thrifty
    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            place = batch.column("sort_a").to_numpy()
            for lo, hi in row_ranges(off, _SLICE_BYTES, 1 << 20):
                s = segments(data, off[lo : hi + 1], length)
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor.view(np.int64)), pa.array(s.name.view(np.int64)), pa.array(place[lo:hi][s.doc]), pa.array((s.start << (_WINDOW_BITS + 1)) | (s.windows << 1) | s.again)], names=["anchor", "name", "place", "span"])

    return run


def _fetch(length: int):
    """The bytes of the segments that are asked for, hot ones in parts."""

    def run(group: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(group):
            group = _rows(group)
            data, off = _buffer(group)
            row = np.searchsorted(group.column("sort_a").to_numpy(), asked.column("place").to_numpy())
            for i, anchor, place, span, hot in zip(row, *(asked.column(c).to_pylist() for c in ("anchor", "place", "span", "hot"))):
                start, n = span >> (_WINDOW_BITS + 1), (span >> 1) & ((1 << _WINDOW_BITS) - 1)
                at = int(off[i]) + start
                b = data[at : at + n + length - 1]
                if hot:
                    pair = lambda name, anchor=anchor: int(mix(np.array([anchor], dtype=np.int64).view(np.uint64) ^ np.array([name], dtype=np.int64).view(np.uint64)).view(np.int64)[0])
                    for j, m, name in split_segment(b, n, length):
                        piece = b[j : j + m + length - 1].tobytes()
                        out.append((pair(name), place, start + j, m, piece, hashlib.blake2b(piece, digest_size=16).digest()))
                else:
                    out.append((anchor, place, start, n, b.tobytes(), None))
        common.release()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["anchor", "place", "start", "windows", "piece", "content"])

    return run


def _match(length: int, batch_bytes: int):
    """Over one task's segments: (place, first, windows) of each run of windows that occur twice or more."""

    @common.thrifty
    def run(batches):
        family = SuffixFamily(length)
        owner, held, size = [], [], 0  # of each window number: place and window, in batches

        def flush():
            n = np.array([len(x[3]) for x in held])
            windows = np.array([x[2] for x in held])
            first = np.cumsum(n) - n
            within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            family.add(np.frombuffer(b"".join(x[3] for x in held), dtype=np.uint8), np.repeat(first, windows) + within)
            owner.append((np.repeat([x[0] for x in held], windows), np.repeat([x[1] for x in held], windows) + within))

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("place", "start", "windows", "piece"))):
                held.append(row)
                size += len(row[3])
                if size >= batch_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if not owner:
            return
        place, at = (np.concatenate(x) for x in zip(*owner))
        hit = np.flatnonzero(family.hit)
        place, at = place[hit], at[hit]
        order = np.lexsort((at, place))
        place, at = place[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
        for i in range(0, len(new), 1 << 16):
            own = new[i : i + (1 << 16)]
            until = np.append(new, len(at))[i + 1 : i + 1 + len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(place[own]), pa.array(at[own]), pa.array(until - own)], names=["place", "first", "windows"])

    return run


def _cut(length: int, texts: bool):
    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        group = _rows(group)
        data, off = _buffer(group)
        cover = np.zeros(int(off[-1] - off[0]) + 1, dtype=np.int32)
        if len(found):
            named, place = group.column("sort_a").to_numpy(), found.column("place").to_numpy()
            lo, hi = np.searchsorted(named, place, side="left"), np.searchsorted(named, place, side="right")
            n = hi - lo
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at = off[row] - off[0] + np.repeat(found.column("first").to_numpy(), n)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + np.repeat(found.column("windows").to_numpy(), n) + length - 1, -1)
        removed, spans, kept = [], [], []
        depth = 0
        for lo, hi in row_ranges(off, _SLICE_BYTES, 1 << 20):
            at = off[lo : hi + 1] - off[lo]
            own = cover[off[lo] - off[0] : off[hi] - off[0]]
            covered = np.cumsum(own, dtype=np.int32) + depth
            depth = int(covered[-1]) if len(covered) else depth
            gone = covered > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(gone)]
            begins[inner] = gone[inner]
            count = lambda x, at=at: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(x)]))
            n = count(gone)
            removed.append(n)
            spans.append(count(begins))
            for i in range(lo, hi):
                b = data[off[i] : off[i + 1]]
                k = (b[~gone[at[i - lo] : at[i - lo + 1]]] if n[i - lo] else b).tobytes()
                kept.append(k.decode("utf-8", errors="ignore") if texts else hashlib.sha256(k).hexdigest())
        del cover
        common.release()
        out = {"n_bytes": np.diff(off), "n_removed": np.concatenate(removed), "n_spans": np.concatenate(spans)}
        if texts:
            return pa.table({"rest": group.column("rest"), **out, "kept": pa.array(kept, pa.string())})
        return pa.table({"doc_id": group.column("doc_id"), **out, "kept_sha256": pa.array(kept, pa.string())})

    return run


def _dealt_and_found(d: DataFrame, length: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows (text without nulls, more columns) by block, and the runs of repeated windows by block."""
    spark = d.sparkSession
    common.small_batches(spark)
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, common.blocks_for(common.text_bytes(d), block_bytes))
    # computed once, since three steps need it; all of it is narrow, and texts are dealt out only once
    asked = common.stored(d.select("sort_a", "text").mapInArrow(_ask(length), _ASK), "segments")
    block = lambda place: F.pmod(F.col(place), F.lit(blocks)).cast("int").alias("block")
    dealt = d.select("*", block("sort_a")).repartition(blocks, "block")
    # anchors with one segment are done, but for one that may repeat in itself
    again = F.col("span").bitwiseAND(F.lit(1))
    keys = asked.groupBy("anchor").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b"), F.max(again).alias("again")).where("n > 1 or again = 1")
    near = common.stored(asked.join(keys.select("anchor", "n", (F.col("a") != F.col("b")).alias("mixed")), "anchor"), "shared")
    common.discard(asked)
    same = near.groupBy("anchor", "name").agg(F.count("*").alias("copies"), F.min(F.struct("place", "span")).alias("one"), F.max("n").alias("n"), F.max("mixed").alias("mixed"))
    # segments that are equal repeat as a whole; what is stored and dealt anew lets a skewed join be split
    repeated = common.stored(same.where("copies > 1").select("anchor", "name"), "repeated")
    twice = near.select("anchor", "name", "place", "span").join(repeated, ["anchor", "name"])
    first, windows = F.shiftright("span", _WINDOW_BITS + 1), F.shiftright("span", 1).bitwiseAND(F.lit((1 << _WINDOW_BITS) - 1))
    whole = twice.select("place", first.alias("first"), windows.alias("windows"))
    # one of each different segment takes part in the index
    wanted = same.where("mixed or copies = 1 and one.span & 1 = 1").select("anchor", "one.place", "one.span", (F.col("n") > HOT).alias("hot")).select("*", block("place"))
    pieces = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_fetch(length), "anchor long, place long, start long, windows long, piece binary, content binary")
    pieces = common.stored(pieces, "pieces")
    # parts of hot anchors that are equal repeat as a whole as well; one of each takes part in the index
    parts = pieces.where("content is not null")
    alike = parts.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("place", "start")).alias("one"))
    repeated = common.stored(alike.where("copies > 1").select("anchor", "content"), "repeated-parts")
    again = parts.select("anchor", "content", "place", "start", "windows").join(repeated, ["anchor", "content"])
    again = again.select("place", F.col("start").alias("first"), "windows")
    one = parts.join(alike.select("one.place", "one.start"), ["place", "start"], "left_semi")
    open_ = pieces.where("content is null").unionByName(one).drop("content")
    partly = open_.repartition(2 * blocks, "anchor").mapInArrow(_match(length, BATCH_BYTES), "place long, first long, windows long")
    found = whole.unionByName(again).unionByName(partly).select("*", block("place"))
    return dealt, found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each input row.

    Texts are UTF-8 bytes, null ones empty; matches never cross rows; rows that repeat an id or a text are rows of their own,
    so their passages repeat. Null ids stay null; other columns are dropped.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({"sort_a": F.xxhash64("doc_id", "text"), "sort_b": F.coalesce("doc_id", F.lit(-1).cast("long"))})
    dealt, found = _dealt_and_found(d, length, block_bytes)
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(length, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with repeated passages cut out of text_col, all columns kept; null texts become empty.

    Where a passage begins or ends inside a character, that character's remaining bytes go too.
    """
    rest = [c for c in docs.columns if c != text_col]
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    named = F.to_json("rest") if "map<" in d.schema["rest"].dataType.simpleString() else F.col("rest")  # maps cannot be hashed
    d = d.withColumns({"sort_a": F.xxhash64(named, "text"), "sort_b": F.xxhash64("text")})
    dealt, found = _dealt_and_found(d, length, block_bytes)
    out = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(length, True), StructType([d.schema["rest"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept string")]))
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes repeated passages of 200 bytes and more from all documents."""
    return remove_repeats(common.table(spark, sf_dir, "documents"))


#: The same as op6_suffix_arrays, by counting the hashes of all windows of 200 bytes; for small tables.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (SELECT doc_id, n, 512 * i AS base, substr(h, 1024 * i + 1, 1424) AS piece FROM (SELECT *, unnest(range((n + 511) // 512)) AS i FROM d)
), w AS (SELECT doc_id, base + i AS p, hash(substr(piece, 2 * i + 1, 400)) AS k FROM (SELECT *, unnest(range(512)) AS i FROM c) WHERE base + i + 200 <= n
), t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1
), m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM w JOIN t USING (k)
), g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM m
), s AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM g GROUP BY doc_id, span
), gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(s.hi), 0), any_value(n) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo, hi) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n::bigint AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
