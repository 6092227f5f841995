"""Semi-global alignment of reads with parts of targets.

Many pairs of like lengths are aligned at once: row i of all their score tables is one array, so that Python's work grows with
the rows of a block of pairs and not with pairs or letters. A first pass finds the best ends and keeps some rows; the way back
then fills the rows between two kept ones again, last ones first, so that no table is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SketchParams
from ..storage import bounded_broadcast

MATCH, MISMATCH, GAP = 2, -1, -1
#: Numbers that a block of pairs may hold in its arrays; one pair that needs more is a block of its own.
BLOCK_CELLS = 1 << 23
#: Letters of a piece of a target, in which slices are looked up.
PIECE = 1 << 16
_DIAGONAL, _UP, _LEFT, _END = 0, 1, 2, 3
_GAP_SIGN = ord("_")


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text begins in it (and the last ends)."""
    values = texts.to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])
    return np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def _grid(letters: np.ndarray, starts: np.ndarray, which: np.ndarray, fill: int) -> np.ndarray:
    """Texts side by side as rows of equal length; fill behind their ends."""
    n = starts[which + 1] - starts[which]
    at = np.arange(int(n.max(initial=0)))
    own = at < n[:, None]
    out = np.full(own.shape, fill, dtype=np.uint32)
    out[own] = letters[(starts[which][:, None] + at)[own]]
    return out


def _complements(grid: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Reverse complements of rows of n letters each; letters other than the four bases stay."""
    at = n[:, None] - 1 - np.arange(grid.shape[1])
    turned = np.where(at >= 0, np.take_along_axis(grid, np.maximum(at, 0), axis=1), grid)
    out = turned.copy()
    for a, b in zip(b"ACGTacgt", b"TGCAtgca"):
        out[turned == a] = b
    return out


def _next_row(row: np.ndarray, letter: np.ndarray, b: np.ndarray, steps: np.ndarray, scheme: tuple[int, int, int]) -> np.ndarray:
    """The row below, for all pairs: what comes from the left is a running maximum of the other scores less the gaps passed."""
    match, mismatch, gap = scheme
    new = np.zeros_like(row)
    np.maximum(row[:, :-1] + np.where(b == letter[:, None], np.int32(match), np.int32(mismatch)), row[:, 1:] + np.int32(gap), out=new[:, 1:])
    new -= steps
    np.maximum.accumulate(new, axis=1, out=new)
    new += steps
    return new


def _best_ends(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, scheme: tuple[int, int, int], every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(score, end row, end column) of each pair, and each every-th row. n does not rise from pair to pair, so that pairs that
    are through are left out. The last row counts before the last column, and first places before later ones."""
    pairs, width = b.shape
    steps = (scheme[2] * np.arange(width + 1)).astype(np.int32)
    row, kept = np.zeros((pairs, width + 1), dtype=np.int32), []
    down, at_row = np.zeros(pairs, dtype=np.int32), np.zeros(pairs, dtype=np.int64)
    last, at_column = np.zeros(pairs, dtype=np.int32), np.zeros(pairs, dtype=np.int64)
    for i in range(a.shape[1] + 1):
        alive = int(np.searchsorted(-n, -i, side="right"))
        if i:
            row = _next_row(row[:alive], a[:alive, i - 1], b[:alive], steps, scheme)
        if i % every == 0:
            kept.append(row)
        side = row[np.arange(alive), m[:alive]]
        better = np.flatnonzero(side > down[:alive])
        down[better], at_row[better] = side[better], i
        through = np.flatnonzero(n[:alive] == i)
        if len(through):
            own = np.where(np.arange(width + 1) <= m[through][:, None], row[through], np.iinfo(np.int32).min)
            at_column[through] = own.argmax(axis=1)
            last[through] = own[np.arange(len(through)), at_column[through]]
    below = last >= down
    return np.where(below, last, down), np.where(below, n, at_row), np.where(below, at_column, m), kept


def _moves(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, end_row: np.ndarray, end_column: np.ndarray, kept: list[np.ndarray], every: int, scheme: tuple[int, int, int]) -> np.ndarray:
    """The way back from both ends of each pair to its start: a move for each letter pair or gap, then _END."""
    pairs, width = b.shape
    match, mismatch, gap = scheme
    steps = (gap * np.arange(width + 1)).astype(np.int32)
    i, j, done = n.copy(), m.copy(), np.zeros(pairs, dtype=np.int64)
    moves = np.full((pairs, a.shape[1] + width), _END, dtype=np.uint8)
    for low in range(every * (len(kept) - 1), -1, -every):
        act = np.flatnonzero(i > low)
        if not len(act):
            continue
        row, high = kept[low // every], int(i[act].max())
        toward = np.full((high - low, pairs, width), _LEFT, dtype=np.uint8)
        for r in range(low + 1, high + 1):
            alive = int(np.searchsorted(-n, -r, side="right"))
            new = _next_row(row[:alive], a[:alive, r - 1], b[:alive], steps, scheme)
            own = toward[r - low - 1, :alive]
            own[new[:, 1:] == row[:alive, 1:] + gap] = _UP
            own[new[:, 1:] == row[:alive, :-1] + np.where(b[:alive] == a[:alive, r - 1, None], match, mismatch)] = _DIAGONAL
            row = new
        while len(act):
            x, y = i[act], j[act]
            move = toward[x - low - 1, act, np.maximum(y - 1, 0)] if width else np.full(len(act), _UP, dtype=np.uint8)
            # free ends: before the best end is reached and after one text has begun there is one way only
            move = np.where((x == n[act]) & (y > end_column[act]), _LEFT, np.where((y == 0) | ((y == m[act]) & (x > end_row[act])), _UP, move))
            moves[act, done[act]] = move
            done[act] += 1
            i[act] = x - (move != _LEFT)
            j[act] = y - (move != _UP)
            act = act[i[act] > low]
    at = np.arange(moves.shape[1])
    moves[(at >= done[:, None]) & (at < (done + j)[:, None])] = _LEFT
    return moves


def _texts(grid: np.ndarray, own: np.ndarray) -> pa.Array:
    """Rows of code points, of which own ones count, as strings."""
    flat, n = grid[own], own.sum(axis=1)
    size = 1 + (flat >= 0x80).astype(np.int32) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])]
    data = flat.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _aligned_block(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, scheme: tuple[int, int, int], strands: bool, every: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Scores and both rows of pairs whose n does not rise; with strands the better of query and reverse complement."""
    score, end_row, end_column, kept = _best_ends(a, n, b, m, scheme, every)
    if strands:
        turned = _complements(a, n)
        other = _best_ends(turned, n, b, m, scheme, every)
        swap = other[0] >= score
        a, score = np.where(swap[:, None], turned, a), np.where(swap, other[0], score)
        end_row, end_column = np.where(swap, other[1], end_row), np.where(swap, other[2], end_column)
        kept = [np.where(swap[: len(x), None], y, x) for x, y in zip(kept, other[3])]
    moves = _moves(a, n, b, m, end_row, end_column, kept, every, scheme)[:, ::-1]
    own = moves != _END

    def beside(letters: np.ndarray, passed: np.ndarray) -> np.ndarray:
        if not letters.shape[1]:
            return np.full(moves.shape, _GAP_SIGN, dtype=np.uint32)
        at = np.maximum(np.cumsum(passed, axis=1) - 1, 0)
        return np.where(passed, np.take_along_axis(letters, at, axis=1), np.uint32(_GAP_SIGN))

    return score, _texts(beside(a, own & (moves != _LEFT)), own), _texts(beside(b, own & (moves != _UP)), own)


def _blocks(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of like lengths together, as many as BLOCK_CELLS allows; longer queries first in a block."""
    order = np.lexsort((m, np.ceil(np.log2(n + 1))))
    while len(order):
        head = order[:8192]
        rows, columns = np.maximum.accumulate(n[head]), np.maximum.accumulate(m[head]) + 1
        cells = np.arange(1, len(head) + 1) * (columns * (48 + 6 * np.sqrt(rows)) + 4 * rows)
        take = max(1, int(np.searchsorted(cells, BLOCK_CELLS, side="right")))
        block, order = head[:take], order[take:]
        yield block[np.argsort(-n[block], kind="stable")]


def align_pairs(queries: pa.Array, subjects: pa.Array, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, strands: bool = False) -> pa.RecordBatch:
    """(score, query, subject) of each pair in order: the best score and both rows with "_" for gaps; gaps at either end are
    free, a gap must not score above 0. Null texts count as empty. strands: the better of the query and its reverse complement,
    the latter if both score the same. Of equal ways back, letter pairs come before gaps in the subject, these before gaps in the query."""
    (q, q_starts), (s, s_starts) = _letters(queries.fill_null("")), _letters(subjects.fill_null(""))
    n, m = np.diff(q_starts), np.diff(s_starts)
    scores, places, rows = np.zeros(len(n), dtype=np.int32), [], ([], [])
    for which in _blocks(n, m):
        every = max(16, int(2 * np.sqrt(n[which].max())))
        score, top, bottom = _aligned_block(_grid(q, q_starts, which, 1 << 31), n[which], _grid(s, s_starts, which, 1 << 30), m[which], (match, mismatch, gap), strands, every)
        scores[which] = score
        places.append(which)
        rows[0].append(top)
        rows[1].append(bottom)
    back = pa.array(np.argsort(np.concatenate([*places, np.zeros(0, dtype=np.int64)]), kind="stable"))
    text = lambda parts: pa.chunked_array(parts, pa.string()).combine_chunks().take(back)
    return pa.RecordBatch.from_arrays([pa.array(scores), text(rows[0]), text(rows[1])], names=["score", "query", "subject"])


def slices(candidates: DataFrame, targets: DataFrame, p: SketchParams) -> DataFrame:
    """candidates (tgt, beg, end, ...) with part: the letters of the target that its range of windows covers, null where there are none.

    Targets are cut into pieces where they lie, and pieces that no candidate needs go before anything else moves: with few
    candidates, whose size is checked, by a broadcast, otherwise by a shuffle of pieces, never of whole targets.
    """
    start, stop = F.col("beg").cast("long") * p.stride, F.col("end").cast("long") * p.stride + p.window
    keys = ["tgt", "beg", "end"]
    ranges = candidates.select(*keys).distinct()
    ranges = ranges.select(*keys, F.explode(F.sequence(F.floor(start / PIECE), F.floor((stop - 1) / PIECE))).alias("piece"))
    letters = F.col("dna").cast("binary")
    pieces = targets.where("length(dna) > 0").select("tgt", letters.alias("dna"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("dna") - 1) / PIECE))).alias("piece"))
    pieces = pieces.select("tgt", "piece", F.substring("dna", (F.col("piece") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("letters"))
    found = pieces.join(bounded_broadcast(ranges, 64), ["tgt", "piece"])
    first = F.greatest(start - F.col("piece") * PIECE, F.lit(0))
    found = found.select(*keys, "piece", F.substring("letters", (first + 1).cast("int"), (F.least(stop - F.col("piece") * PIECE, F.lit(PIECE)) - first).cast("int")).cast("string").alias("own"))
    whole = found.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "").alias("part"))
    return candidates.join(whole, keys, "left")


def aligned(pairs: DataFrame, keys: list[str], match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> DataFrame:
    """keys and (score, query, subject) of rows with seq1 and part, both strands tried."""

    def run(batches):
        for b in batches:
            done = align_pairs(b.column("seq1"), b.column("part"), match, mismatch, gap, True)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *done.columns], names=[*keys, "score", "query", "subject"])

    d = pairs.select(*keys, F.col("seq1").cast("string").alias("seq1"), F.col("part").cast("string").alias("part"))
    return d.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema) + "score int, query string, subject string")


def align_candidates(candidates: DataFrame, reads: DataFrame, targets: DataFrame, p: SketchParams, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> DataFrame:
    """(query_id, tgt, score, query, subject) for (query_id, tgt, beg, end) rows; the first mate is aligned. Rows of unknown
    reads and of targets without letters are left out."""
    parts = slices(candidates.select("query_id", "tgt", "beg", "end"), targets.select("tgt", "dna"), p).where("part is not null")
    return aligned(parts.join(reads.select("query_id", "seq1"), "query_id"), ["query_id", "tgt"], match, mismatch, gap)
