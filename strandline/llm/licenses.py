"""License scans by ordered signature rules.

A text becomes its lower-case words. An automaton over all rules' keywords reads it once and tells which rules can match;
only their regular expressions are run, each over the whole text. A detection is a stretch of words; one that lies inside a
detection of an earlier rule is suppressed (equal stretches: the earlier rule wins), and decoys suppress without being
reported. As an earlier rule's own suppressor would also contain what it contains, the outcome does not depend on the order
of work. Each text is scanned by itself: no shuffle, and rows are dealt as they are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_rules import RULES, Rule
from .textvec import text_buffer

#: Phrases whose places are always reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Confidence of a place of a base phrase.
BASE_CONFIDENCE = {"cc-by": 0.6, "gpl": 0.8, "reserved": 0.4}

_WORDS = np.full(256, 0x20, dtype=np.uint8)  # each byte of a word, A-Z lowered; a space for all that separates words
for _i in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORDS[_i] = _i
_WORDS[0x41:0x5B] = np.arange(0x61, 0x7B)


def doubled(text: str) -> str:
    """text with two spaces for each: so every word has a space of its own on either side, and neighbours can both match."""
    return text.replace(" ", "  ")


def expression(rule: Rule) -> str:
    """The rule's expression over doubled words; ` ?` is a space that may be missing."""
    return f" (?:{doubled(rule.pattern.replace(' ?', '\0')).replace('\0', '(?:  )?')}) "


def words_text(raw: np.ndarray) -> str:
    """The words of a UTF-8 text, lowered, each with a space before and behind it; no word gives an empty text."""
    b = _WORDS[raw]
    keep = b != 0x20
    keep[1:] |= keep[:-1]  # the first separator behind a word stays
    words = b[keep].tobytes().rstrip(b" ").replace(b" ", b"  ")
    return f" {words.decode('utf-8', 'replace')} " if words else ""


class Scanner:
    """Compiled rules: the automaton of keywords, and the expressions in the order of the rules."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.expressions = [re.compile(expression(r)) for r in rules]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_keyword.setdefault(doubled(r.keyword), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, numbers in by_keyword.items():
            self.automaton.add_word(k, (k, numbers))
        if by_keyword:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules whose keyword stands in text, in their order."""
        if not self.rules:
            return []
        found = {k: numbers for _, (k, numbers) in self.automaton.iter(text)}
        return sorted(i for numbers in found.values() for i in numbers)

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, first word, end word) of what is left after suppression, decoys left out; text as words_text() gives it."""
        found = [(i, m.start(), m.end()) for i in self.candidates(text) for m in self.expressions[i].finditer(text)]
        if not found:
            return []
        kept, held = [], Containment()
        for i, lo, hi in found:  # in the order of rules
            if held.contains(lo, hi):
                continue
            held.add(lo, hi)
            if self.rules[i].label:
                kept.append((i, lo, hi))
        kept.sort(key=lambda d: (d[1], d[2], d[0]))
        return [(i, a, b) for (i, _, _), (a, b) in zip(kept, word_numbers(text, [(lo, hi) for _, lo, hi in kept]))]


class Containment:
    """Intervals, none inside another, sorted by start (so by end as well): whether one of them contains a given interval."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def contains(self, lo: int, hi: int) -> bool:
        at = bisect_right(self.starts, lo) - 1  # of those that start no later, the last one ends last
        return at >= 0 and self.ends[at] >= hi

    def add(self, lo: int, hi: int) -> None:
        """Adds an interval that none contains; those inside it are no longer needed to answer contains()."""
        at = bisect_right(self.starts, lo)
        first = at - 1 if at and self.starts[at - 1] == lo else at
        last = first
        while last < len(self.starts) and self.ends[last] <= hi:
            last += 1
        self.starts[first:last] = [lo]
        self.ends[first:last] = [hi]


def word_numbers(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word numbers of character spans of doubled words, spans in ascending order of their starts."""
    out, at, words = [], 0, 0
    for lo, hi in spans:
        words += text.count(" ", at, lo) // 2 if at <= lo else 0
        at = lo
        out.append((words, words + text.count(" ", lo, hi) // 2))
    return out


def places(text: str, phrase: str) -> list[int]:
    """Characters at which a phrase of different words starts in doubled words."""
    out, sought = [], f" {doubled(phrase)} "
    at = text.find(sought)
    while at >= 0:
        out.append(at)
        at = text.find(sought, at + len(sought))  # its words differ, so that places never overlap
    return out


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(list(rules))


_DETECTION = "struct<label: string, rule: int, first_word: bigint, n_words: bigint, confidence: double, base: boolean>"
SCHEMA = f"doc_id long, n_words long, detections array<{_DETECTION}>"
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("confidence", pa.float64()), ("base", pa.bool_())]))


def _scan(raw: np.ndarray, scanner: Scanner) -> tuple[int, list[dict]]:
    text = words_text(raw)
    spans = sorted((at, at + len(doubled(p)) + 2, label) for p, label in BASE.items() for at in places(text, p))
    found = [
        {"label": label, "rule": None, "first_word": a, "n_words": b - a, "confidence": BASE_CONFIDENCE[label], "base": True}
        for (_, _, label), (a, b) in zip(spans, word_numbers(text, [(lo, hi) for lo, hi, _ in spans]))
    ]
    for i, a, b in scanner.detections(text):
        found.append({"label": scanner.rules[i].label, "rule": i, "first_word": a, "n_words": b - a, "confidence": scanner.rules[i].confidence, "base": False})
    return text.count(" ") // 2, found


def detect(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, detections: places of base phrases and what the rules detect, with word numbers from 0.

    One row for each input row; other columns are dropped, whatever their names. Null and empty texts have no words and no
    detections; null ids stay null; repeated rows give the same each. rule is the number of the rule in its table, null at
    base phrases, which nothing suppresses.
    """
    held = tuple(rules)

    @common.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(held)
        for b in batches:
            data, off = text_buffer(b.column("text"))
            rows = [_scan(data[off[i] : off[i + 1]], scanner) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([d for _, d in rows], _ARROW)], names=["doc_id", "n_words", "detections"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def summaries(found: DataFrame) -> DataFrame:
    """One row for each row of detect(): counts, the span of base places, labels, and the highest confidence as score."""
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    at = F.transform(base, lambda d: d["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences, notices and rights statements of every document."""
    return summaries(detect(common.table(spark, sf_dir, "documents")))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quoted(r.label)}, {quoted(doubled(r.keyword))}, {quoted(expression(r))}, {r.confidence})" for i, r in enumerate(RULES))
    base = ", ".join(f"({quoted(label)}, {quoted(f' {doubled(p)} ')}, {BASE_CONFIDENCE[label]})" for p, label in BASE.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = lambda ex, sep, p: f"SELECT {ex}, t, {sep}(t, {p}) AS gaps"
    at = "list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)"
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (SELECT row, doc_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS t FROM words),
rules(rule, label, keyword, pattern, confidence) AS (VALUES {rules}),
base(label, phrase, confidence) AS (VALUES {base}),
base_cut AS ({cut("row, label, confidence, phrase", "string_split", "phrase")} FROM t, base WHERE contains(t, phrase)),
places AS (SELECT row, label, confidence, left(t, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * length(phrase))::BIGINT) AS before FROM base_cut, unnest(range(1, len(gaps))) AS u(i)),
based AS (SELECT row, label, confidence, {spaces("before")} AS first_word FROM places),
rule_cut AS (SELECT row, rule, label, confidence, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits FROM t, rules WHERE contains(t, keyword)),
spans AS (SELECT row, rule, label, confidence, ({at})::BIGINT AS lo, length(hits[i]) AS n FROM rule_cut, unnest(range(1, len(hits) + 1)) AS u(i)),
kept AS (
  SELECT * FROM spans s WHERE label <> '' AND NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.row = s.row AND o.rule < s.rule AND o.lo <= s.lo AND o.lo + o.n >= s.lo + s.n)
), found AS (SELECT row, label, confidence, first_word FROM based UNION ALL SELECT row, label, confidence, NULL FROM kept),
per AS (
  SELECT row, count(first_word) AS n_base, min(first_word) AS first_word, max(first_word) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (first_word IS NOT NULL)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score FROM found GROUP BY row
)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM t LEFT JOIN per USING (row)"""


OP13_SQL = _sql()
