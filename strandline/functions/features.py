"""Which k-mers of a window are its features, and what number stands for each: policies that are chosen by name.

A database stores the names with its other parameters, so that reads are sketched as its targets were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SketchParams
from . import dna, hashes


@dataclass(frozen=True)
class FeatureHash:
    """The same function of a k-mer's code twice: of a column of longs and of an array of unsigned 64-bit numbers.

    bits: 32 (codes and hashes below 2^32, for k up to 16) or 64 (longs whose bits stand for unsigned numbers). The number
    whose bits are all ones is no feature.
    """

    bits: int
    column: Callable[[Column], Column]
    numpy: Callable[[np.ndarray], np.ndarray]

    @property
    def none(self) -> int:
        return (1 << self.bits) - 1


@dataclass(frozen=True)
class Selection:
    """Which k-mers may be features: a condition on a k-mer (upper case, without other letters) and the same on the places of a
    sequence, given two-bit codes of its letters. It must hold for a k-mer's reverse complement as well."""

    column: Callable[[Column, int], Column] | None = None
    numpy: Callable[[np.ndarray, int], np.ndarray] | None = None


def mix32(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    return (x >> np.uint64(16)) ^ x


def _finaliser(steps: tuple) -> Callable[[np.ndarray], np.ndarray]:
    def run(x: np.ndarray) -> np.ndarray:
        rounds, last = steps
        for shift, factor in rounds:
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(last)

    return run


def canonical_codes(base: np.ndarray, k: int) -> np.ndarray:
    """The smaller code of each k-mer and its reverse complement; k is at most 32."""
    m = max(0, len(base) - k + 1)
    fwd, rev = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.uint64)
    for j in range(k):
        b = base[j : j + m].astype(np.uint64)
        fwd = fwd << np.uint64(2) | b
        rev |= (np.uint64(3) - b) << np.uint64(2 * j)
    return np.minimum(fwd, rev)


def inner_length(k: int) -> int:
    """Letters of the inner k-mers that decide about a closed syncmer."""
    return max(1, k // 2)


def _closed(kmer: Column, k: int) -> Column:
    inner = F.transform(dna.kmers(kmer, inner_length(k)), lambda x: dna.hash32(dna.code(dna.canonical(x))))
    return F.transform(F.array(inner), lambda x: (F.array_min(x) == x[0]) | (F.array_min(x) == F.element_at(x, -1)))[0]


def _closed_places(base: np.ndarray, k: int) -> np.ndarray:
    s = inner_length(k)
    h = mix32(canonical_codes(base, s))
    spread = k - s + 1
    return np.minimum(h[: len(h) - spread + 1], h[spread - 1 :]) == np.lib.stride_tricks.sliding_window_view(h, spread).min(axis=1)


#: By name; more may be added before a database is built or loaded.
HASHES = {
    "mix32": FeatureHash(32, dna.hash32, mix32),
    "murmur64": FeatureHash(64, hashes.murmur64, _finaliser(hashes.MURMUR64)),
    "splitmix64": FeatureHash(64, hashes.splitmix64, _finaliser(hashes.SPLITMIX64)),
}
#: minhash takes all k-mers, syncmer those of whose inner k-mers the first or last one has the smallest hash.
SELECTIONS = {"minhash": Selection(), "syncmer": Selection(_closed, _closed_places)}


def policy(p: SketchParams) -> tuple[FeatureHash, Selection]:
    """The functions that p names; ValueError if a name is not known or the hash is too narrow for k."""
    if p.hasher not in HASHES or p.sketcher not in SELECTIONS:
        raise ValueError(f"no feature hash {p.hasher!r} or no sketcher {p.sketcher!r} is known")
    own = HASHES[p.hasher], SELECTIONS[p.sketcher]
    if p.k * 2 > own[0].bits:
        raise ValueError(f"{p.hasher} does not hold k-mers of {p.k} letters")
    return own


def sketch(window: Column, p: SketchParams) -> Column:
    """Features of a window (any case): the smallest distinct hashes of selected canonical k-mers without other letters,
    ascending as unsigned numbers, at most p.size."""
    hasher, selection = policy(p)
    plain = F.filter(dna.kmers(F.upper(window), p.k), dna.unambiguous)
    if selection.column is not None:
        plain = F.filter(plain, lambda x: selection.column(x, p.k))
    found = F.transform(plain, lambda x: hasher.column(dna.code(dna.canonical(x), p.k)))
    if hasher.bits == 32:
        return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda h: h != F.lit(hasher.none)))), 1, p.size)
    # signed order with the first bit turned is unsigned order
    turn = lambda h: h.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    kept = F.transform(F.array_distinct(F.filter(found, lambda h: h != F.lit(-1).cast("long"))), turn)
    return F.transform(F.slice(F.array_sort(kept), 1, p.size), turn)
