"""Byte-level BPE: exact encoding by tree concatenation, and decoding.

A long text is cut into leaves that are encoded in parallel. Most cuts lie where a word of the pre-tokenizer ends for
certain, whatever stands around them (CERTAIN), so that the ids on both sides are simply put together. Text without such
a place, one word of any length, is cut anywhere, and its halves are joined in a tree: the last tokens of the left side and
the first ones of the right side are encoded anew in a window that grows until its first token is the left side's and its
last token the right side's.

Why the join is exact: ids are the encoding of one word if and only if each two neighbours among them are that of their own
bytes, since the first merge to cross a border between two tokens would cross it in those two alone as well. Inside the left
side, the window and the right side neighbours are such pairs, and where they meet the agreeing tokens make them so.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The pre-tokenizer's pattern and the special token of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Borders between two characters that no word of PATTERN crosses. Inside a run of one kind, after white space
#: and between an apostrophe and a letter a word may go on; everywhere else it ends.
CERTAIN = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"
#: Texts of more characters are cut into leaves of at most so many.
LEAF = 32_768
#: Tokens on each side of a join that the first window holds, characters whose ids a worker holds at once, and ids that are
#: turned into text at once.
WINDOW, HELD, CHUNK = 16, 1 << 18, 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder over a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.token = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for k, v in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.token[v] = k
        self.decimal = [str(i) for i in range(len(self.token))]
        self.words, self.certain = regex.compile(PATTERN), regex.compile(CERTAIN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text, without cutting it."""
        return self.core.encode_to_numpy(text, allowed_special="all")

    def leaves(self, text: str, leaf: int = LEAF) -> Iterator[tuple[str, bool]]:
        """Parts of a text, at most leaf characters each, and whether a part goes on in the word that the one before ends in.

        Special tokens are parts of their own.
        """
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield part, False
                continue
            at = 0
            while len(part) - at > leaf:
                found = self.certain.search(part, at + max(1, leaf // 2), at + leaf)
                if found:
                    yield part[at : found.start()], False
                    at = found.start()
                    continue
                found = self.certain.search(part, at + leaf)
                end = found.start() if found else len(part)
                yield from self._word_parts(part, at, end, leaf)
                at = end
            if at < len(part):
                yield part[at:], False

    def _word_parts(self, text: str, at: int, end: int, leaf: int) -> Iterator[tuple[str, bool]]:
        """Parts of text[at:end], which holds few words and a long one among them; words of over leaf characters are cut."""
        begin = at
        for m in self.words.finditer(text, at, end):
            if m.end() - begin > leaf and m.start() > begin:
                yield text[begin : m.start()], False
                begin = m.start()
            if m.end() - m.start() > leaf:
                for i in range(m.start(), m.end(), leaf):
                    yield text[i : min(i + leaf, m.end())], i > m.start()
                begin = m.end()
        if begin < end:
            yield text[begin:end], False

    def join(self, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """The ids of a word from those of its two halves. The window grows from so many tokens on each side."""
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            anew = np.array(self.core._encode_single_piece(self.decode_bytes([*left[i:].tolist(), *right[:j].tolist()])), dtype=np.uint32)
            if (not i or anew[0] == left[i]) and (j == len(right) or anew[-1] == right[j - 1]):
                return np.concatenate([left[:i], anew, right[j:]])
            window *= 2

    def tree(self, parts: list[tuple[np.ndarray, bool]]) -> np.ndarray:
        """The ids of a text from those of its leaves: halves of one word are joined pairwise, level by level."""
        out: list[np.ndarray] = []
        word: list[np.ndarray] = []
        for ids, goes_on in [*parts, (None, False)]:
            if not goes_on:
                while len(word) > 1:
                    word = [self.join(*word[i : i + 2]) if i + 1 < len(word) else word[i] for i in range(0, len(word), 2)]
                out, word = out + word, []
            word.append(ids)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids of a text of any length, by tree concatenation where it is longer than leaf."""
        if len(text) <= leaf:
            return self.whole(text)
        return self.tree([(self.whole(part), goes_on) for part, goes_on in self.leaves(text, leaf)])

    def decode_bytes(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimals joined by commas, SHA-256 of the decoded text in UTF-8; part by part."""
        decimal, text, plain = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(ids), CHUNK):
            own = ids[i : i + CHUNK].tolist()
            decimal.update(("," * (i > 0) + ",".join([self.decimal[x] for x in own])).encode())
            text.update(plain.decode(self.decode_bytes(own), i + CHUNK >= len(ids)).encode())
        return len(ids), decimal.hexdigest(), text.hexdigest()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    return Bpe(path)


def _cut(path: str, leaf: int):
    """Rows of (row, doc_id, copies, text) as one row for each leaf."""

    @common.thrifty
    def run(batches):
        coder = bpe(path)
        for b in batches:
            for row, doc, copies, text in zip(*(b.column(c) for c in ("row", "doc_id", "copies", "text"))):
                held, size, part = [], 0, 0
                for piece, goes_on in coder.leaves(text.as_py(), leaf):
                    held.append((row.as_py(), doc.as_py(), copies.as_py(), part, goes_on, piece))
                    size, part = size + len(piece), part + 1
                    if size > HELD:
                        yield _rows(held, _LEAVES)
                        held, size = [], 0
                if held:
                    yield _rows(held, _LEAVES)

    return run


_LEAVES = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("copies", pa.int32()), ("part", pa.int32()), ("goes_on", pa.bool_()), ("piece", pa.string())])
_ENCODED = pa.schema([*list(_LEAVES)[:-1], ("ids", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _leaf_ids(path: str):
    @common.thrifty
    def run(batches):
        coder = bpe(path)
        for b in batches:
            ids = [coder.whole(t.as_py()).astype("<u4").tobytes() for t in b.column("piece")]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in list(_LEAVES)[:-1]), pa.array(ids, pa.binary())], schema=_ENCODED)

    return run


def _joined(path: str, finish):
    """For rows sorted by (row, part): one result for each row, made of its leaves. Holds the ids of one document at a time."""

    @common.thrifty
    def run(batches):
        coder = bpe(path)
        now, doc, copies, parts = None, None, 0, []

        def done():
            ids = coder.tree(parts)
            for _ in range(copies):
                yield finish(coder, [doc], [ids])

        for b in batches:
            for row, i, n, _, goes_on, ids in zip(*(b.column(f.name) for f in _ENCODED)):
                if row.as_py() != now:
                    if parts:
                        yield from done()
                    now, doc, copies, parts = row.as_py(), i.as_py(), n.as_py(), []
                parts.append((np.frombuffer(ids.as_py(), dtype="<u4").astype(np.uint32), goes_on.as_py()))
        if parts:
            yield from done()

    return run


def _finish_digests(coder: Bpe, docs, ids) -> pa.RecordBatch:
    n, a, b = zip(*(coder.digests(x) for x in ids)) if len(ids) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _finish_ids(coder: Bpe, docs, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([coder.decode(x.tolist()) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_IDS = "doc_id long, ids array<int>, decoded string"


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """Ids and decoded text (or, with digests, their SHA-256) of every document; one row for each input row.

    Null text counts as empty and has no ids; null ids stay null; repeated rows give repeated results; other columns are
    dropped. Texts of at most leaf characters are encoded where they are read. Longer ones (and only they) are cut into
    leaves, dealt out, encoded in parallel and joined in a tree. A worker holds one whole text while it is cut, and the ids
    of one text (4 bytes each) while they are joined.
    """
    common.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    finish, schema = (_finish_digests, _DIGESTS) if digests else (_finish_ids, _IDS)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = F.length("text") > leaf

    @common.thrifty
    def direct(batches):
        coder = bpe(path)
        docs, ids, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                own = text.as_py()
                docs.append(doc_id)
                ids.append(coder.whole(own))
                size += len(own)
                if size > HELD:
                    yield finish(coder, docs, ids)
                    docs, ids, size = [], [], 0
        if docs:
            yield finish(coder, docs, ids)

    short = d.where(~split).mapInArrow(direct, schema)
    # a row's name must not depend on where it is read: equal rows share one, and their number is carried along
    long = d.where(split).groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").cast("int").alias("copies"))
    long = long.select(F.concat_ws(":", F.col("doc_id").cast("string"), "sha").alias("row"), "doc_id", "copies", "text")
    leaves = long.mapInArrow(_cut(path, leaf), "row string, doc_id long, copies int, part int, goes_on boolean, piece string")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = leaves.repartition(n, "row", "part").mapInArrow(_leaf_ids(path), "row string, doc_id long, copies int, part int, goes_on boolean, ids binary")
    joined = encoded.repartition(n, "row").sortWithinPartitions("row", "part").mapInArrow(_joined(path, finish), schema)
    return short.unionByName(joined)


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    return encode_documents(common.table(spark, sf_dir, "documents"), digests=True)
