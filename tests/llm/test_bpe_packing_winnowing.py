import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import regex
import xxhash
from odd_tables import TEXTS, with_clashing_columns
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import bpe, packing, winnowing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'aersrevl1!é漢<|endoftext|>", max_size=60), st.integers(5, 20))
def test_tree_concatenation_is_exact(text, leaf):
    coder = bpe.bpe(PATH)
    assert coder.encode(text, leaf).tolist() == ids_of(text)


def unsplit(n, alphabet, seed=1):
    r = random.Random(seed)
    return "".join(r.choices(alphabet, k=n))


ALPHABETS = ["a", " ", "ab", "eth", "0123456789", "ACGT", "=-", "漢字かな", "éà", "\U0001f600\U0001f601", "abcdefghijklmnopqrstuvwxyz", "\u200d\u0301"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_joins_inside_long_words_are_exact(alphabet):
    coder = bpe.bpe(PATH)
    for n, leaf in ((1, 1), (400, 1), (3000, 3), (3000, 64), (20_000, 1000)):
        text = unsplit(n, alphabet, n)
        for t in (text, "x" + text, text + "x", "it's " + text + "'s"):
            assert coder.encode(t, leaf).tolist() == ids_of(t)


@pytest.mark.parametrize("alphabet", ["ACGT", "a", "漢字かな", " ", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_long_words_are_encoded_little_more_than_once(alphabet):
    coder, n = bpe.bpe(PATH), 1_000_000
    text, seen = unsplit(n, alphabet), []
    whole, single = coder.whole, coder.core._encode_single_piece
    coder.whole = lambda t: seen.append(len(t.encode())) or whole(t)
    coder.core._encode_single_piece = lambda b: seen.append(len(b)) or single(b)
    try:
        found = coder.encode(text)
    finally:
        del coder.whole, coder.core._encode_single_piece
    assert found.tolist() == ids_of(text)
    assert sum(seen) < 1.2 * len(text.encode()) and max(seen) <= 8 * bpe.LEAF


def test_certain_borders_are_ends_of_words():
    """Whatever characters meet: for each pair of kinds, what CERTAIN cuts the pattern's words cut as well."""
    coder, r = bpe.bpe(PATH), random.Random(5)
    for _ in range(3000):
        text = "".join(r.choices("aZ1９é漢 \n\t\u3000\u00a0'!.\u0301sredlvtm", k=12))
        ends = {m.end() for m in coder.words.finditer(text)}
        assert {m.start() for m in coder.certain.finditer(text)} <= ends


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.integers(1, 6))
def test_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.bpe(PATH).encode(text, leaf).tolist() == ids_of(text)


def test_digests_of_broken_characters():
    coder = bpe.bpe(PATH)
    ids = coder.whole("漢字" * 30_000 + "é")[:-1]
    n, a, b = coder.digests(ids)
    want = coder.decode(ids.tolist()).encode()
    assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(want).hexdigest())


def test_long_words_through_spark(spark):
    texts = [unsplit(1_200_000, "ACGT"), unsplit(90_000, "漢字") + " end", unsplit(100_000, " \n"), "<|endoftext|>" + "b" * 70_000 + "<|endoftext|>"]
    found = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert found[i].ids == ids_of(t) and found[i].decoded == t


@pytest.mark.parametrize("leaf", [bpe.LEAF, 16])
def test_encode_documents(spark, odd_docs, leaf):
    found = bpe.encode_documents(with_clashing_columns(odd_docs), leaf=leaf, digests=True).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(ids_of(r.text)), hashlib.sha256(",".join(map(str, ids_of(r.text))).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect())
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in found) == want


def test_encode_empty_table(no_docs):
    assert bpe.encode_documents(no_docs).count() == 0


def check_packing(docs, found):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    text = {r.doc_id: r.text for r in docs}
    for d, own in pieces.items():
        ids = [*ids_of(text[d]), 0]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return set(pieces), padding / max(1, total)


def test_pack_documents(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = packing.pack_documents(with_clashing_columns(docs)).collect()
    seen, padding = check_packing(docs.collect(), found)
    assert seen == set(range(len(TEXTS))) and padding < 0.02


def test_pack_repeated_null_and_no_rows(odd_docs, no_docs):
    whole = packing.pack_documents(odd_docs).collect()
    assert sum(r.length for r in whole) == sum(len(ids_of(r.text)) + 1 for r in odd_docs.collect())
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0, 1)), max_size=60))
def test_vector_limits_hold(sizes):
    limits = packing.Limits(tokens=40, segments=3, loss_tokens=25, waiting=8)
    items = [packing.Item(i, n, min(25, int(n * f)), cut=False) for i, (n, f) in enumerate(sizes)]
    loss = {x.key: x.loss for x in items}
    bins = defaultdict(list)
    for p in packing.VectorPacker(limits).pack([packing.Item(x.key, x.tokens, x.loss, False) for x in items]):
        bins[p.sequence].append(p)
    assert sorted(p.key for own in bins.values() for p in own) == list(range(len(items)))
    for own in bins.values():
        assert sum(p.length for p in own) <= 40 and len(own) <= 3 and sum(loss[p.key] for p in own) <= 25


def plain_packing(demands, limits):
    """The dot-product rule, one item after the other, for items that may not be cut: demands by sequence."""
    top = (limits.tokens, limits.segments, limits.loss_tokens)
    waiting, out = [], []

    def fill():
        left, own = list(top), []
        while True:
            fit = [d for d in waiting if all(x <= y for x, y in zip(d, left))]
            if not fit:
                return own
            d = max(fit, key=lambda d: sum(x * y / z / z for x, y, z in zip(d, left, top)))
            waiting.remove(d)
            own.append(d)
            left = [y - x for x, y in zip(d, left)]

    for d in demands:
        waiting.append(d)
        if len(waiting) >= 2 * limits.waiting:
            while len(waiting) > limits.waiting:
                out.append(fill())
    while waiting:
        out.append(fill())
    return out


def closed_by(sequences, limits):
    """Which limits leave no room for the smallest demand that there is (one token of one segment, with loss)."""
    full = [0, 0, 0]
    for own in sequences:
        for i, (x, y) in enumerate(zip(map(sum, zip(*own)), (limits.tokens, limits.segments, limits.loss_tokens))):
            full[i] += x >= 0.95 * y
    return full


def test_items_are_chosen_by_the_dot_product():
    r, limits = random.Random(8), packing.Limits(tokens=997, segments=7, loss_tokens=401, waiting=20)
    kinds = [lambda: (r.randrange(300, 900), 0), lambda: (lambda n: (n, n))(r.randrange(20, 390)), lambda: (r.randrange(1, 40), 0)]
    items = [(n, 1, loss) for n, loss in ((r.choice(kinds))() for _ in range(600))]
    found, demand = defaultdict(list), dict(enumerate(items))
    for p in packing.VectorPacker(limits).pack([packing.Item(i, n, loss, False) for i, (n, _, loss) in demand.items()]):
        found[p.sequence].append(demand[p.key])
    want = plain_packing(items, limits)
    assert [found[i] for i in sorted(found)] == want
    assert all(n > 5 for n in closed_by(want, limits))
    largest_first = plain_packing(items, packing.Limits(997, 10**6, 10**6, 20))
    assert [x[0] for x in largest_first] != [x[0] for x in want]  # the other limits change what is taken


def test_documents_reach_the_segment_limit_without_padding(spark):
    rows = [(i, "w " * (3 if i % 6 else 900)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = packing.pack_documents(docs).collect()
    seen, padding = check_packing(docs.collect(), found)
    count = defaultdict(int)
    for x in found:
        count[x.sequence_id] += 1
    assert len(seen) == 600 and padding < 0.1 and max(count.values()) == packing.Limits().segments
    assert sum(n == packing.Limits().segments for n in count.values()) > 20


def test_instruction_data_reaches_every_limit(spark):
    from strandline.llm import registry

    found = registry.queries()["instruction_packing"](spark, "/root/testdata/sf0.1").collect()
    own, lim = defaultdict(list), packing.INSTRUCTIONS
    for x in found:
        own[x.sequence_id].append((x.length, 1, x.loss_tokens))
    assert all(a <= b for s in own.values() for a, b in zip(map(sum, zip(*s)), (lim.tokens, lim.segments, lim.loss_tokens)))
    print(len(own), closed_by(own.values(), lim))
    assert all(n > 0 for n in closed_by(own.values(), lim))


def test_pack_conversations(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "general"), (2, 0, None, None), (2, 1, "assistant", "long " * 3000), (None, None, None, "x")]
    found = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.length for r in found) == sum(len(ids_of(r[3])) + 1 for r in rows)
    assert sum(r.loss_tokens for r in found) == sum(len(ids_of(r[3])) + 1 for r in rows if r[2] == "assistant")


def brute_fingerprint(text, k=winnowing.K, w=winnowing.W):
    h = lambda b, seed=42: xxhash.xxh64(b, seed=seed).intdigest()
    pattern = regex.compile(winnowing.TOKEN.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003ffff"))
    tokens = [h(t.encode()) for t in pattern.findall(text or "")]

    def gram(own):
        x = 42
        for t in own:
            x = h(struct.pack("<Q", t), x)
        return x >> 33

    if not tokens:
        return []
    grams = [gram(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    kept = []
    for i in range(max(1, len(grams) - w + 1)):
        best = min(range(i, min(i + w, len(grams))), key=lambda j: (grams[j], -j))
        if not kept or kept[-1] != best:
            kept.append(best)
    return [(grams[j], j) for j in kept]


def test_winnowing_against_brute_force(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [r.text or "" for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    found = {r.doc_id: r for r in winnowing.compare_with_edits(with_clashing_columns(docs)).collect()}
    assert len(found) == len(texts)
    text_of = lambda fp: " ".join(f"{a:x}@{b}" for a, b in fp)
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, a, b, c = found[i], brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(after)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == text_of(a) and r.edited_fingerprint == text_of(b)
        sa, sb, sc = ({x for x, _ in y} for y in (a, b, c))
        assert r.near_edited == pytest.approx(like(sa, sb)) and r.near_next == pytest.approx(like(sa, sc))


def test_winnowing_next_over_many_ranges(spark):
    rows = [(i * 7 % 101, f"text {i * 7 % 101} " * 20) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = winnowing.with_next(df, "doc_id", ["doc_id", "text"], {"after": "doc_id"}, bucket_bytes=300).collect()
    assert {(r.doc_id, r.after) for r in found} == {(i, (i + 1) % 101) for i in range(101)}


def test_buckets_by_two_steps(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 3, 10, 57, 400):
        bounds = sorted(r.sample(range(-500, 500), n))
        values = [None, -600, 600, *bounds, *(r.randrange(-550, 550) for _ in range(50))]
        found = spark.createDataFrame([(v,) for v in values], "v long").select("v", winnowing._bucket(F.col("v"), bounds).alias("b")).collect()
        assert [x.b for x in found] == [0 if v is None else sum(b <= v for b in bounds) for v in values]


def test_winnowing_nulls_repeats_and_no_rows(odd_docs, no_docs):
    assert winnowing.compare_with_edits(odd_docs).count() == odd_docs.count()
    assert winnowing.compare_with_edits(no_docs).count() == 0
    assert winnowing.fingerprint_documents(no_docs).count() == 0


def test_shared_passage_is_guaranteed(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(winnowing.K + winnowing.W - 1))
    rows = [(i, " ".join(word() for _ in range(r.randrange(50))) + " " + shared + " " + " ".join(word() for _ in range(r.randrange(50)))) for i in range(20)]
    found = winnowing.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set.intersection(*({x >> 32 for x in f.fingerprint} for f in found))
