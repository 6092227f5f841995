"""Parameters of building, querying and evaluating, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Ranks in ascending order; a rank's number is its place.
RANKS = ["sequence", "form", "variety", "subspecies", "species", "subgenus", "genus", "subtribe", "tribe", "subfamily", "family", "suborder", "order", "subclass", "class", "subphylum", "phylum", "subkingdom", "kingdom", "domain", "root", "none"]
#: Other spellings of ranks.
RANK_SYNONYMS = {"genome": "sequence", "forma": "form", "varietas": "variety", "species group": "subgenus", "species subgroup": "subgenus", "superfamily": "suborder", "parvorder": "suborder", "infraorder": "suborder", "superorder": "subclass", "infraclass": "subclass", "superclass": "subphylum", "division": "phylum", "superphylum": "subkingdom", "subdomain": "kingdom", "superkingdom": "domain"}
ROOT, NONE = RANKS.index("root"), RANKS.index("none")
NUM_RANKS = NONE
#: Most locations that one feature may have.
MAX_LOCATIONS = 254


def rank_number(name: str | None) -> int:
    """The number of a rank's name in any case; unknown names are "none"."""
    n = (name or "").strip().lower()
    n = RANK_SYNONYMS.get(n, n)
    return RANKS.index(n) if n in RANKS else NONE


@dataclass(frozen=True)
class SketchParams:
    """k: letters of a k-mer (1 to 32); size: features of a sketch; window and stride in letters (stride 0: window - k + 1).

    sketcher and hasher name what functions/features.py has; without one the hash has 32 bits for k up to 16, else 64.
    """

    k: int = 16
    size: int = 16
    window: int = 128
    stride: int = 0
    sketcher: str = "minhash"
    hasher: str = ""

    def __post_init__(self):
        object.__setattr__(self, "k", min(32, max(1, self.k)))
        object.__setattr__(self, "hasher", self.hasher or ("mix32" if self.k <= 16 else "murmur64"))
        object.__setattr__(self, "size", max(1, self.size))
        if self.stride <= 0:
            object.__setattr__(self, "stride", max(1, self.window - self.k + 1))


@dataclass(frozen=True)
class ClassifyParams:
    """hits_min 0: deduced from the sketch size. hits_diff over 1: a percentage. max_candidates under 1: no limit."""

    hits_min: int = 0
    hits_diff: float = 1.0
    max_candidates: int = 2
    insert_size: int = 0
    lowest: int = 0
    highest: int = RANKS.index("domain")

    def resolved(self, sketch_size: int = 16) -> ClassifyParams:
        low = self.hits_min or (sketch_size // 3 if sketch_size >= 6 else 2 if sketch_size >= 4 else 1)
        diff = self.hits_diff / 100 if self.hits_diff > 1 else self.hits_diff
        return replace(self, hits_min=low, hits_diff=diff, lowest=min(self.lowest, self.highest), max_candidates=self.max_candidates if self.max_candidates >= 1 else 2**31 - 1)


def merge_params(p: ClassifyParams) -> ClassifyParams:
    """What merging results uses: at least five hits where none are given, and no rank below species."""
    return replace(p, hits_min=p.hits_min or 5, lowest=max(p.lowest, RANKS.index("species")))
