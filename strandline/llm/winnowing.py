"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are words (a script written without spaces gives one token a character, see TOKEN). Every k consecutive tokens are
hashed; of every window of w consecutive hashes the smallest is kept, the rightmost where several are equal, with its
position. Any passage of at least k + w - 1 tokens that two texts share thus gives both the same kept hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, W = 5, 12
#: Ranges of scripts that are written without spaces. There a character is a token, elsewhere a word is.
_UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\x{20000}-\x{3FFFF}"
TOKEN = rf"[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]+"


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with the column out: kept hashes with positions as array<bigint>, in the order of positions.

    An entry holds the 31-bit hash above 32 bits that count down from the token's position. Fewer than k tokens are one
    gram, fewer than w grams one window; no token gives an empty array, and null text counts as empty. Positions reach
    4 294 967 295.
    """
    t, g = f"__{out}_tokens", f"__{out}_grams"
    n, m = f"size(`{t}`)", f"size(`{g}`)"
    gram = f"if({n} < {k}, xxhash64(`{t}`), xxhash64({', '.join(f'get(`{t}`, i + {j})' for j in range(k))}))"
    # of equal hashes the one at the largest position has the smallest entry
    entry = f"shiftleft(shiftrightunsigned({gram}, 33), 32) | (4294967295L - i)"
    window = f"least({', '.join(f'get(`{g}`, i + {j})' for j in range(w))})"
    none = "cast(array() as array<bigint>)"
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.expr(f"if({n} = 0, {none}, transform(sequence(0, greatest({n} - {k}, 0)), i -> {entry}))"))
    df = df.withColumn(out, F.expr(f"if({m} <= {w}, if({m} = 0, {none}, array(array_min(`{g}`))), array_distinct(transform(sequence(0, {m} - {w}), i -> {window})))"))
    return df.drop(t, g)


def hashes(fingerprint: Column) -> Column:
    """The distinct kept hashes, without their positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Common part of two arrays of hashes, 0 to 1; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_string(fingerprint: Column) -> Column:
    """hash@position of each entry, in hexadecimal and decimal, separated by blanks."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit("@"), (F.lit(4294967295) - x.bitwiseAND(F.lit(4294967295))).cast("string"))), " ")


def _longs(values: list[int]) -> Column:
    """A constant array; one literal, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above value; null: 0. First among every step-th of them, then in one step."""
    step = max(1, math.isqrt(len(bounds)))
    every, all_ = _longs(bounds[::step]), _longs(bounds)
    before = F.size(F.filter(every, lambda b: b <= value))
    inside = F.size(F.filter(F.slice(all_, F.greatest((before - 1) * step + 1, F.lit(1)), F.lit(step)), lambda b: b <= value))
    return F.coalesce(F.when(before > 0, (before - 1) * step + inside).otherwise(0), F.lit(0)).cast("int")


def with_next(df: DataFrame, id_col: str, order: list[str], carried: dict[str, str], bucket_bytes: int = 8 << 20, text: str = "text", max_buckets: int = 1 << 16) -> DataFrame:
    """df with, in new columns (new name -> column), what the next row by order has; the last row gets the first one's.

    Rows are dealt into ranges of id_col that hold about bucket_bytes of text each (more where there would be over max_buckets
    ranges: from half a terabyte of text on they grow with it). The first id's rows of every range are also sent to the range
    before, so that a window function inside a range sees every successor: one shuffle, no single partition. Two numbers for
    each range come to the driver, and a row is compared with twice the root of as many.
    """
    n = min(max_buckets, common.blocks_for(common.text_bytes(df, text), bucket_bytes))
    points = [i / n for i in range(1, n)]
    bounds = sorted(set(df.agg(F.percentile_approx(id_col, points, max(10_000, 10 * n)).alias("b")).first()["b"] or [])) if points else []
    bucket = _bucket(F.col(id_col), bounds)
    firsts = {r["b"]: r["first"] for r in df.groupBy(bucket.alias("b")).agg(F.min(F.struct(F.col(id_col).alias("i"))).alias("first")).collect()}
    if not firsts:
        return df.withColumns({k: F.col(v) for k, v in carried.items()})
    there = sorted(firsts)
    size = there[-1] + 1
    null_first = [b for b in there if firsts[b]["i"] is None]  # the first range alone, if any
    first_ids = _longs([firsts[b]["i"] if b in firsts and firsts[b]["i"] is not None else 0 for b in range(size)])
    before = {b: there[i - 1] for i, b in enumerate(there)}
    previous = _longs([before.get(b, 0) for b in range(size)])
    df = df.withColumn("__b", bucket)
    own, nulls = F.col(id_col), F.array(*map(F.lit, null_first)).cast("array<int>")
    sent = F.coalesce(F.when(F.array_contains(nulls, F.col("__b")), own.isNull()).otherwise(own == F.get(first_ids, F.col("__b"))), F.lit(False))
    copies = F.when(sent, F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("s")), F.struct(F.get(previous, F.col("__b")).cast("int").alias("b"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("s"))))
    df = df.withColumn("__c", F.explode(copies)).withColumn("__b", F.col("__c.b")).withColumn("__s", F.col("__c.s")).drop("__c")
    w = Window.partitionBy("__b").orderBy("__s", *(F.col(c).asc_nulls_first() for c in order))
    return df.withColumns({k: F.lead(v).over(w) for k, v in carried.items()}).where("__s = 0").drop("__b", "__s")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every document: doc_id, n_chars, fingerprint (array<bigint>); null text counts as empty."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprint(d, "text", "fingerprint", k, w).select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and that of the next document.

    The edited text has the last half of the characters (rounded down) replaced by as many first ones of the next document,
    or all if it has fewer. One row for each input row; null text counts as empty; null ids come first; rows that share an
    id follow each other in the order of their texts, and equal rows in any order. Other columns are dropped.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(with_fingerprint(d, "text", "own", k, w), "doc_id", ["doc_id", "text"], {"next_text": "text", "next_own": "own"})
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "edited", "own", "next_own")
    d = with_fingerprint(d.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "changed", k, w).drop("edited")
    d = d.withColumns({"a": hashes(F.col("own")), "b": hashes(F.col("changed")), "c": hashes(F.col("next_own"))})
    return d.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every whole text of documents and its edited text."""
    return compare_with_edits(common.table(spark, sf_dir, "documents"))
