"""Column functions on sequence headers and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of accession numbers, in the order in which they are tried.
ACCESSION_PREFIXES = ["GCF_", "AC_", "NC_", "NG_", "NS_", "NT_", "NW_", "NZ_", "MKHE", "AE", "AJ", "AL", "AM", "AP", "AY", "BA", "BK", "BX", "CC", "CM", "CP", "CR", "CT", "CU", "FM", "FN", "FO", "FP", "FQ", "FR", "HE", "JH"]
#: What ends an accession number; the first of these that occurs counts, not the nearest.
ACCESSION_ENDS = ["|", " ", "-", "_", ","]


def _find(text: Column, what: str, start: Column | int = 1) -> Column:
    """1-based place of what at or after start; 0 if there is none."""
    return F.call_function("locate", F.lit(what), text, start if isinstance(start, Column) else F.lit(start))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _find_column(text: Column, what: Column, start: Column) -> Column:
    return F.call_function("locate", what, text, start)


def _end(text: Column, start: Column) -> Column:
    """1-based place of the end (exclusive) of an accession that is known to reach start."""
    found = F.filter(F.transform(F.array(*map(F.lit, ACCESSION_ENDS)), lambda e: _find_column(text, e, start)), lambda p: p > 0)
    return F.coalesce(F.get(found, 0), F.length(text) + 1)


def _cut(text: Column, start: Column | int, end: Column) -> Column:
    start = start if isinstance(start, Column) else F.lit(start)
    return F.trim(F.substring(text, start, end - start))


def _first_prefix(known: Callable[[Column], Column]) -> Column:
    """The first value, neither null nor empty, that known gives for a prefix; else null."""
    tried = F.transform(F.array(*map(F.lit, ACCESSION_PREFIXES)), known)
    return F.get(F.filter(tried, lambda x: x.isNotNull() & (x != "")), 0)


def accession_version(text: Column) -> Column:
    """The accession number with its version, e.g. NC_000913.3; empty if there is none."""
    def known(prefix: Column) -> Column:
        def with_start(i: Column) -> Column:
            return _let(_find_column(text, F.lit("."), i + F.length(prefix)), lambda dot: F.when((i > 0) & (dot > 0) & (dot - i <= 25), _cut(text, i, _end(text, dot + 1))))

        return _let(_find_column(text, prefix, F.lit(1)), with_start)

    plain = _let(_find(text, ".", 2), lambda dot: F.when((dot > 0) & (dot - 1 < 25), _cut(text, 1, _end(text, dot + 1))))
    return F.when(F.length(text) >= 2, F.coalesce(_first_prefix(known), plain, F.lit(""))).otherwise("")


def accession(text: Column) -> Column:
    """The accession number without its version; empty if there is none."""
    def known(prefix: Column) -> Column:
        def with_start(i: Column) -> Column:
            j = i + F.length(prefix)
            return F.when(i > 0, _let(F.struct(_end(text, j).alias("end"), _find_column(text, F.lit("."), j).alias("dot")), lambda x: _cut(text, i, F.when((x.dot > 0) & (x.dot < x.end), x.dot).otherwise(x.end))))

        return _let(_find_column(text, prefix, F.lit(1)), with_start)

    return F.coalesce(_first_prefix(known), F.lit(""))


def gi_number(text: Column) -> Column:
    """What follows "gi|" up to the next bar, or else the next blank."""
    i = _find(text, "gi|")
    bar, blank = _find(text, "|", i + 3), _find(text, " ", i + 3)
    end = F.when(bar > 0, bar).when(blank > 0, blank).otherwise(F.length(text) + 1)
    return F.when(i > 0, _cut(text, i + 3, end)).otherwise("")


def sequence_id(header: Column) -> Column:
    """Accession with version, else accession, else gi number, else the whole header."""
    return F.coalesce(*(F.when(x != "", x) for x in (accession_version(header), accession(header), gi_number(header))), header)


def taxon_id(header: Column) -> Column:
    """The number after "taxid" and one more character; 0 where there is none."""
    i = _find(header, "taxid")
    bar, blank = _find(header, "|", i + 6), _find(header, " ", i + 6)
    end = F.when(bar > 0, bar).when(blank > 0, blank).otherwise(F.length(header) + 1)
    digits = F.regexp_extract(F.substring(header, i + 6, end - i - 6), r"^\s*\+?([0-9]+)", 1)
    return F.when(i > 0, F.coalesce(digits.try_cast("long"), F.lit(0))).otherwise(0).cast("long")


def first_word(header: Column) -> Column:
    return F.substring_index(header, " ", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def annotated(header: Column, taxid: Column, field_separator: str = " ", value_separator: str = "|") -> Column:
    """The header with taxid<value separator><id> behind its first field; an older entry is removed before.

    Null taxid: the header has no id of its own, and nothing is added.
    """
    n = F.length(header)
    j = _find(header, "taxid")
    k = F.when(j > 0, _find(header, value_separator, j + 4))
    field = _find(header, field_separator, k + 1)
    until = F.when(field > 0, field).otherwise(F.when(_find(header, value_separator, k + 1) > 0, _find(header, value_separator, k + 1)).otherwise(n))
    bare = F.when(k > 0, F.concat(F.substring(header, F.lit(1), j - 1), F.substring(header, until + 1, n))).otherwise(header)
    entry = F.concat(F.lit(f"taxid{value_separator}"), taxid.cast("string"), F.lit(field_separator))
    at = F.instr(bare, field_separator)
    added = F.when(at > 0, F.concat(F.substring(bare, F.lit(1), at), entry, F.substring(bare, at + 1, F.length(bare)))).otherwise(F.concat(bare, F.lit(field_separator), entry))
    return F.when(taxid.isNull(), bare).otherwise(added)
