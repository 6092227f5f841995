"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and components.

Signatures: each element of a set draws, for j = 0, 1, ..., a rank r in [j, j + 1) for slot p(j) of its own random
permutation of the slots; a slot keeps the smallest rank. The ranks of one element are thus spread over different slots,
which lowers the variance below that of independent hashes, and an element stops as soon as all slots hold less than j.

Equal sets are one class. Classes that share a band are candidates; connected candidates form a cluster, within which full
sets are compared block by block, so that every pair of a cluster is decided exactly. Links join classes to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import MOST_DOCS, mix, row_ranges, shingle_sets, stream, text_buffer, words_of

#: Slots of a signature, and bands it is cut into: a pair at 0.8 misses all 32 bands of 4 with probability 5e-8.
SLOTS, BANDS = 128, 32
_RANK_BITS = np.uint64(24)
_SLICE_BYTES = 1 << 18
#: Rounding of logarithms does not part sizes that may be linked.
SLACK = 1.0001
#: What one task compares at once: classes, and shingles of all of them. Larger clusters are compared in pairs of blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 2_000, 400_000


def superminhash(sets: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of n_docs sets given as (element, set) sorted by set: uint32 of n_docs x slots, j above 24 bits of rank.

    A set without elements keeps the largest value in every slot.
    """
    full = np.uint32(0xFFFFFFFF)
    sig = np.full(n_docs * slots, full, dtype=np.uint32)
    seeds = stream(31, slots)
    live = np.arange(len(sets))
    first_swap = None
    perm = None
    for j in range(slots):
        x = mix(sets[live] ^ seeds[j])
        rank = (x >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
        k = (j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int64)
        if j == 0:
            slot, first_swap = k, k
        elif j == 1:
            slot, second_swap = np.where(k == first_swap[live], 0, k), k
        else:
            if perm is None:  # the state after two swaps of the identity, for what is still live
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
                row = np.arange(len(live))
                for i, swap in ((0, first_swap[live]), (1, second_swap_all[live])):
                    perm[row, i], perm[row, swap] = perm[row, swap], perm[row, i].copy()
            row = np.arange(len(live))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = slot
        np.minimum.at(sig, doc[live] * slots + slot, rank)
        if j == 1:
            second_swap_all = np.zeros(len(sets), dtype=np.int64)
            second_swap_all[live] = second_swap
        if j < slots - 1:
            open_docs = (sig.reshape(n_docs, slots) >= np.uint32(j + 1) << np.uint32(24)).any(axis=1)
            keep = open_docs[doc[live]]
            if not keep.all():
                live = live[keep]
                if perm is not None:
                    perm = perm[keep]
            if not len(live):
                break
    return sig.reshape(n_docs, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit key for each band, which holds the band's number too."""
    n, slots = sig.shape
    rows = slots // bands
    x = np.broadcast_to(stream(41, bands), (n, bands)).copy()
    for i in range(rows):
        x = mix(x ^ sig.reshape(n, bands, rows)[:, :, i])
    return x.view(np.int64)


def _sets(batches, k: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """For slices of each batch: the batch, first and last row, elements and their rows (from the first)."""
    for b in batches:
        data, off = text_buffer(b.column("text"))
        for lo, hi in row_ranges(off, _SLICE_BYTES, MOST_DOCS):
            yield b, lo, hi, *shingle_sets(words_of(data, off[lo : hi + 1]), k)


def signatures(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, and its band keys, for (doc_id long, text string without nulls)."""

    @common.thrifty
    def run(batches):
        for b, lo, hi, s, doc in _sets(batches, k):
            n = hi - lo
            count = np.bincount(doc, minlength=n)
            names = []
            for seed in (51, 52):
                c = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ stream(seed, 1)[0]), dtype=np.uint64)])
                at = np.concatenate([[0], np.cumsum(count)])
                names.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
            keys = band_keys(superminhash(s, doc, n))
            lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, n), pa.array(count, pa.int64()), pa.array(names[0]), pa.array(names[1]), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and the sorted hashes of its shingles."""

    @common.thrifty
    def run(batches):
        for b, lo, hi, s, doc in _sets(batches, k):
            off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(off, pa.array(s.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all common parts of a block's sets: a symmetric matrix, empty on its diagonal.

    Elements in few sets add their pairs one by one, those in many (at most nnz / 32 elements) through a matrix product.
    """
    m = len(sets)
    out = np.zeros((m, m), dtype=np.int32)
    member = np.repeat(np.arange(m), [len(s) for s in sets])
    if not len(member):
        return out
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    element, member = element[order], member[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    df = np.diff(np.append(first, len(element)))
    flat = out.ravel()
    for d in range(2, 33):
        at = first[df == d]
        if len(at):
            own = member[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(i):
                    np.add.at(flat, own[:, j] * m + own[:, i], 1)
    at, size = first[df > 32], df[df > 32]
    for lo in range(0, len(at), 2048):
        a, n = at[lo : lo + 2048], size[lo : lo + 2048]
        column = np.repeat(np.arange(len(a)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        dense = np.zeros((m, len(a)), dtype=np.float32)
        dense[member[inside], column] = 1
        out += np.triu(dense @ dense.T, 1).astype(np.int32)
    return out + out.T


def block_links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from each linked class to the smallest one that it reaches in this block, by links with a similarity of at
    least percent hundredths; where side has two values only links between the sides count."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common_part = intersections(sets).astype(np.int64)
    link = 100 * common_part >= percent * (size[:, None] + size[None, :] - common_part)
    link &= common_part > 0
    if side.any() and not side.all():
        link &= side[:, None] != side[None, :]
    seen = np.zeros(len(ids), dtype=bool)
    out = []
    for i in np.argsort(ids, kind="stable"):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            new = np.flatnonzero(link[todo.pop()] & ~seen)
            seen[new] = True
            todo += new.tolist()
            out += [(int(ids[i]), int(ids[x])) for x in new]
    return out


def _verify(percent: int):
    """Over rows sorted by (cluster, i, j): edges of each group. Holds one group, at most two blocks, at a time."""

    @common.thrifty
    def run(batches):
        now, held = None, []

        def edges():
            if len(held) > 1:
                return block_links(np.array([x[0] for x in held]), np.array([x[1] for x in held]), [x[2] for x in held], percent)
            return []

        def batch(out):
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            out = []
            off, flat = (lambda c: (c.offsets.to_numpy(), c.values.to_numpy()))(b.column("shingles"))
            keys = list(zip(*(b.column(c).to_pylist() for c in ("cluster", "i", "j"))))
            for r, (key, doc, side) in enumerate(zip(keys, b.column("doc_id").to_pylist(), b.column("side").to_pylist())):
                if key != now:
                    out += edges()
                    now, held = key, []
                held.append((doc, side, flat[off[r] : off[r + 1]].copy()))
            yield batch(out)
        yield batch(edges())

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked by 100 * common >= percent * joint k-word shingles.

    One row for each input row, other columns are dropped. component_id is the smallest id that a chain of links reaches,
    kept tells whether it is the row's own. Null and empty texts have no shingles and are linked with nothing. Rows that
    repeat an id share a component if any of them is linked; a null id is never linked, and kept.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = common.stored(signatures(d, k), "signatures")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal sets are one class, named by its smallest id
    linkable = known.where("n_shingles > 0 and doc_id is not null")
    classes = common.stored(linkable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    same = linkable.join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    # classes that share a band are candidates: each is tied to the smallest of its bucket
    keyed = classes.select("rep", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    candidates = keyed.join(shared.select("band", "low"), "band").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    cluster = common.components(candidates).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    member = common.stored(cluster.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id"), "members")
    # a large cluster is dealt into classes of similar size, of which only neighbours can hold links, and these into blocks;
    # each member goes to the pairs of blocks that its own takes part in
    large = member.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where((F.col("n") > BLOCK_CLASSES) | (F.col("s") > BLOCK_SHINGLES))
    member = member.join(large.select("cluster", F.lit(True).alias("large")), "cluster", "left")
    member = member.withColumn("like", F.when(F.col("large"), F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(SLACK * 100 / percent))).otherwise(0).cast("int"))
    size = common.stored(member.groupBy("cluster", "like").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "blocks")
    more = size.select("cluster", (F.col("like") - 1).alias("like"), F.col("blocks").alias("above")).unionByName(size.select("cluster", (F.col("like") + 1).alias("like"), F.col("blocks").alias("below")), allowMissingColumns=True)
    more = more.groupBy("cluster", "like").agg(F.max("above").alias("above"), F.max("below").alias("below"))
    member = member.join(size.join(more, ["cluster", "like"], "left"), ["cluster", "like"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    wanted = common.stored(member.select("doc_id", "cluster", "like", "blocks", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"), "own"), "wanted")
    sets = full_sets(d.join(common.bounded_broadcast(wanted.select("doc_id").distinct(), 16), "doc_id", "left_semi"), k)
    # i and j: a class of sizes and a block in it, as one number; the smaller one first
    name = lambda like, block: F.shiftleft(like.cast("long"), 32) + block
    others = lambda shift, n: F.transform(F.filter(F.sequence(F.lit(0), n), lambda x: x < n), lambda x: name(F.col("like") + shift, x))
    placed = sets.join(wanted, "doc_id").withColumn("me", name(F.col("like"), F.col("own")))
    placed = placed.withColumn("other", F.explode(F.concat(others(-1, F.col("below")), others(0, F.col("blocks")), others(1, F.col("above")))))
    placed = placed.select("cluster", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "doc_id", (F.col("me") > F.col("other")).cast("int").alias("side"), "shingles")
    links = placed.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_verify(percent), "a long, b long")
    found = common.components(links.unionByName(same)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = known.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns; null ids stay.

    Of rows that repeat both doc_id and text one stays.
    """
    judged = near_duplicates(docs, k, percent, "doc_id", text_col)
    gone = common.stored(judged.where("not kept").select("doc_id").distinct(), "gone")
    kept = docs.join(common.bounded_broadcast(gone, 16), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    again = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64(F.col(f"`{text_col}`")).alias("h")).count().where("count > 1")
    again = common.stored(again.select("doc_id").distinct(), "again")
    if again.isEmpty():
        return kept
    again = common.bounded_broadcast(again, 16)  # only texts of these ids are shuffled
    own, rest = (kept.join(again, "doc_id", how).select(*(F.col(f"`{c}`") for c in docs.columns)) for how in ("left_semi", "left_anti"))
    return rest.union(own.dropDuplicates(["doc_id", text_col]))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4)


#: The same as op9_superminhash, by comparing all documents that share a shingle; for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.a, l.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""
