"""Vector bin packing of examples into training sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: of the waiting items that still fit in every dimension it takes the
one whose demand, scaled by the limits, has the largest dot product with what is left of the sequence, so that items that
use much of what is plentiful go first. Items that may be cut fill up what remains. Every task packs what it reads: no
shuffle, bounded memory (a window of waiting items), and a retried task makes the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import bpe, default_vocabulary


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. waiting: how many items are looked at together."""

    tokens: int = 1024
    segments: int = 8
    loss_tokens: int = 1023
    waiting: int = 1024


#: Limits for instruction data, where answers alone bear loss.
INSTRUCTIONS = Limits(tokens=2048, segments=16, loss_tokens=1024)


@dataclass
class Item:
    """tokens and loss: its demand. cut: whether it may be divided; each token of a part bears loss then, but for the first
    lead ones, or none does."""

    key: object
    tokens: int
    loss: int
    cut: bool = True
    start: int = 0
    lead: int = 0

    def part(self, at: int, n: int) -> Item:
        """n tokens from the token at on."""
        return Item(self.key, n, max(0, n - self.lead) if self.loss or self.lead else 0, True, self.start + at, self.lead)


@dataclass
class Placement:
    sequence: int
    offset: int
    key: object
    start: int
    length: int


@dataclass
class _Open:
    number: int
    used: int = 0
    placed: list[Placement] = field(default_factory=list)


class VectorPacker:
    """Places a stream of items; sequences are numbered from first."""

    def __init__(self, limits: Limits, first: int = 0):
        self.limits, self.next = limits, first
        self.items: list[Item] = []
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.need = np.zeros((2 * limits.waiting + 1, 3))

    def pack(self, items: Iterable[Item]) -> Iterator[Placement]:
        """All placements. An item that fits in no empty sequence and may not be cut raises ValueError."""
        for x in items:
            yield from self.add(x)
        yield from self.finish()

    def add(self, x: Item) -> Iterator[Placement]:
        lim = self.limits
        if x.cut:
            while x.tokens >= lim.tokens and x.part(0, lim.tokens).loss <= lim.loss_tokens:
                yield Placement(self._number(), 0, x.key, x.start, lim.tokens)
                x = x.part(lim.tokens, x.tokens - lim.tokens)
            if not x.tokens:
                return
        elif x.tokens > lim.tokens or x.loss > lim.loss_tokens:
            raise ValueError(f"{x.key}: {x.tokens} tokens, {x.loss} with loss, fit in no sequence of {lim}")
        self._wait(x)
        if len(self.items) >= 2 * lim.waiting:
            while len(self.items) > lim.waiting:
                yield from self._fill().placed

    def finish(self) -> Iterator[Placement]:
        """Empties the window; the last sequence is divided at powers of two if its items may be cut."""
        while self.items:
            last = self._fill()
            if not self.items and last.used < self.limits.tokens and all(self.cuttable[id(p)] for p in last.placed):
                yield from self._at_powers(last)
            else:
                yield from last.placed

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _wait(self, x: Item) -> None:
        self.need[len(self.items)] = (x.tokens, 1, x.loss)
        self.items.append(x)

    def _take(self, i: int) -> Item:
        x, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return x

    def _fill(self) -> _Open:
        lim, out = self.limits, _Open(self._number())
        left = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=np.float64)
        self.cuttable: dict[int, bool] = {}
        while self.items and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.items)]
            fits = (need <= left).all(axis=1)
            weight = left * self.scale * self.scale
            x = None
            if fits.any() and not (left[1] == 1 and need[:, 0].max() > left[0]):
                x = self._take(int(np.argmax(np.where(fits, need @ weight, -1.0))))
            else:
                # nothing fits whole, or only one segment is left: cut the longest item to what is left
                for i in np.argsort(-need[:, 0], kind="stable"):
                    y = self.items[i]
                    room = int(min(left[0], left[2] + y.lead) if y.loss else left[0])
                    if y.cut and room > 0:
                        n = min(room, y.tokens)
                        x = y.part(0, n)
                        if n == y.tokens:
                            self._take(int(i))
                        else:
                            self.items[i] = y = y.part(n, y.tokens - n)
                            self.need[i] = (y.tokens, 1, y.loss)
                        break
                if x is None:
                    if not fits.any():
                        break
                    x = self._take(int(np.argmax(np.where(fits, need @ weight, -1.0))))
            p = Placement(out.number, out.used, x.key, x.start, x.tokens)
            self.cuttable[id(p)] = x.cut
            out.placed.append(p)
            out.used += x.tokens
            left -= (x.tokens, 1, x.loss)
        return out

    def _at_powers(self, seq: _Open) -> Iterator[Placement]:
        """The same items in sequences whose lengths are powers of two: these need no padding."""
        left, number, offset, first = seq.used, seq.number, 0, True
        size = 1 << (left.bit_length() - 1)
        for p in seq.placed:
            start, n = p.start, p.length
            while n:
                if offset == size:
                    left -= size
                    size, offset, number, first = 1 << (left.bit_length() - 1), 0, self._number(), False
                m = min(n, size - offset)
                yield Placement(number, offset, p.key, start, m)
                start, n, offset = start + m, n - m, offset + m


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str | None = None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most limits.tokens ids.

    Null or empty text is the end id alone; a null id stays null; repeated rows are packed as often as they come; an empty
    table gives no pieces; other columns are dropped. A long text gives as many full sequences as it holds. sequence_id
    holds the partition's number above bit 33. A piece's first id bears no loss, since nothing stands before it.
    """
    common.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])

    @common.thrifty
    def run(batches):
        coder = bpe(path)
        packer = VectorPacker(limits, TaskContext.get().partitionId() << 33)
        held: dict[int, list] = {}  # by row: its id, ids, ids not yet placed
        row = 0

        def rows(placed) -> list[tuple]:
            out = []
            for p in placed:
                doc = held[p.key]
                out.append((doc[0], p.start, p.length, _crc(doc[1][p.start - doc[3] : p.start - doc[3] + p.length]), doc[4], p.sequence, p.offset))
                doc[2] -= p.length
                if not doc[2]:
                    del held[p.key]
            return out

        def batch(out) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(coder.encode(text), np.uint32(end_id))
                held[row] = [doc_id, ids, len(ids), 0, len(ids)]
                out += rows(packer.add(Item(row, len(ids), len(ids) - 1, lead=1)))
                if row in held:  # only what waits is kept
                    done = len(ids) - held[row][2]
                    held[row][1], held[row][3] = ids[done:].copy(), done
                row += 1
            if out:
                yield batch(out)
        if out := rows(packer.finish()):
            yield batch(out)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, _PIECES)


def pack_conversations(turns: DataFrame, vocabulary: str | None = None, limits: Limits = INSTRUCTIONS, loss_role: str = "assistant", end_id: int = 0) -> DataFrame:
    """Instruction data: whole turns of (conv_id, turn, role, text) placed in sequences; only loss_role's turns bear loss.

    One row for each turn: conv_id, turn, start, length, loss_tokens, sequence_id, offset. Turns that no sequence holds are cut
    (several rows, start tells where); null text counts as empty, null roles bear no loss, repeated rows are packed each; null
    ids and turn numbers stay null; other columns are dropped; an empty table gives no rows.
    """
    common.small_batches(turns.sparkSession)
    path = vocabulary or default_vocabulary()
    names = ["conv_id", "turn", "start", "length", "loss_tokens", "sequence_id", "offset"]

    @common.thrifty
    def run(batches):
        coder = bpe(path)
        packer = VectorPacker(limits, TaskContext.get().partitionId() << 33)

        def items():
            for b in batches:
                for c, t, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text"))):
                    n = len(coder.encode(text)) + 1
                    loss = role == loss_role
                    yield Item((c, t, loss), n, n if loss else 0, n > min(limits.tokens, limits.loss_tokens))

        out = []
        for p in packer.pack(items()):
            c, t, loss = p.key
            out.append((c, t, p.start, p.length, p.length if loss else 0, p.sequence, p.offset))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all turns of conversations under limits on tokens, segments and tokens that bear loss."""
    return pack_conversations(common.table(spark, sf_dir, "conversations"))
