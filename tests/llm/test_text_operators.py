import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import with_clashing_columns
from pyspark.sql import functions as F
from strandline.llm import lm, minhash, quality, textvec, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().translate(bytes(textvec.LOWER))


def words(text):
    return WORD.findall((text or "").encode())


def brute_shingles(text, k=4):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute_components(rows, percent=80):
    sets = {i: brute_shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posting = defaultdict(list)
    for i, s in sets.items():
        inter = Counter(j for x in s for j in posting[x])
        for j, n in inter.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            posting[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def copies(n, seed):
    """A family of near copies with more and more edits, exact copies, and texts of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, out = [word() for _ in range(80)], []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(12)):
            own[r.randrange(len(own))] = word()
        out.append(" ".join(own))
    return out + out[:5] + [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(20)]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(minhash, "BLOCK_CLASSES", 20)
    rows = list(enumerate(copies(60, 1) + copies(30, 2) + ["", None, " ", "one two", "ONE two", "one"]))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(with_clashing_columns(df), k=4).collect()}
    assert found == brute_components(rows)


def test_a_cluster_of_many_sizes(spark, monkeypatch):
    """Texts that grow word by word are one candidate cluster; blocks are dealt by size, and no link between sizes is lost."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 6)
    words_ = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words_[: 20 + 3 * i])) for i in range(60)] + [(100 + i, " ".join(words_[i : 60 + i])) for i in range(30)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert found == brute_components(rows)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    found = minhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert all(r.kept for r in found if r.doc_id is None)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    for n, shared in ((40, 30), (400, 200), (3, 2), (1, 1)):
        errors = []
        for _ in range(60):
            a = r.integers(0, 2**52, n, dtype=np.uint64)
            b = np.concatenate([a[:shared], r.integers(0, 2**52, n - shared, dtype=np.uint64)])
            sig = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            errors.append((sig[0] == sig[1]).mean() - shared / (2 * n - shared))
        j = shared / (2 * n - shared)
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) <= 1.15 * math.sqrt(j * (1 - j) / minhash.SLOTS) + 1e-9


def test_superminhash_by_definition():
    """The vectorised rounds equal a plain run of the same draws with whole permutations."""
    m, seeds = 16, textvec.stream(31, 16)
    for n in (1, 2, 7, 60):
        s = np.random.default_rng(n).integers(0, 2**52, n, dtype=np.uint64)
        want = [2**32 - 1] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                x = int(textvec.mix(np.array([e]) ^ seeds[j])[0])
                k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 24 | x >> 40)
        assert minhash.superminhash(s, np.zeros(n, dtype=np.int64), 1, m)[0].tolist() == want


def brute_quality(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in t.encode().split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_against_brute_force(spark, odd_docs):
    r = random.Random(5)
    rows = [(100 + i, "\n".join(" ".join(r.choice(["a", "b", "cé", "#x", "<|", "漢"]) for _ in range(r.randrange(12))) for _ in range(r.randrange(9))), "en", "s", 0) for i in range(60)]
    rows += [(300, "same line\nsame line\n \n \nsame line ", "en", "s", 0), (301, "x\x0by\x0cz\x1cq r s\x85t", "en", "s", 0)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 360, 2)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    text = defaultdict(list)
    for r_ in docs.collect():
        text[r_.doc_id].append(brute_quality(r_.text))
    found = defaultdict(list)
    for f in quality.judge(with_clashing_columns(docs), labels).collect():
        assert f.base_failed == (f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words)
        assert not (f.base_failed and f.kept) and 0 <= f.score <= 1
        found[f.doc_id].append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in text.items()}


def test_quality_keeps_columns_and_bears_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(no_docs, labels).count() == 0
    kept = quality.keep_good(with_clashing_columns(odd_docs), labels)
    assert kept.columns == with_clashing_columns(odd_docs).columns and kept.count() < odd_docs.count()


def test_trees_are_monotonic_and_learn():
    r = np.random.default_rng(2)
    x = r.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) < 0.6) ^ (r.random(3000) < 0.05)).astype(float)
    trees = quality.train(x, y, [-1, 0, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    grid = np.linspace(0, 1, 60)
    for b, c in r.random((20, 2)):
        s = trees.score(np.stack([grid, np.full(60, b), np.full(60, c)], axis=1))
        assert (np.diff(s) <= 1e-12).all()
    assert quality.train(x, np.ones(3000), [0, 0, 0]).score(x).min() > 0.99


def test_trees_equal_a_plain_walk(spark):
    """The query on whole tables: every verdict by walking each tree node by node over statistics of one text alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.learn(docs, labels)
    inner = trees.feature.shape[1]
    found = {r.doc_id: r for r in quality.op7_quality_trees(spark, "/root/testdata/sf0.001").collect()}
    for row in docs.collect():
        counts, x = quality.statistics(*textvec.text_buffer(pa.array([row.text or ""])))
        total = trees.start
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < inner:
                node = 2 * node + (2 if x[0, f[node]] > t[node] else 1)
            total += v[node - inner]
        r, failed = found[row.doc_id], counts[0][0] < 20 or 100 * counts[0][4] > 30 * counts[0][0]
        assert r.base_failed == failed and math.isclose(r.score, 1 / (1 + math.exp(-total)), abs_tol=1e-12)
        assert r.kept == (not failed and r.score >= 0.5)


def toxic_table(spark, n=240):
    r, bad = random.Random(4), ["grumb", "snorf", "blatz"]
    rows, labels = [], []
    for i in range(n):
        t = [f"w{r.randrange(50)}" for _ in range(r.randrange(10, 60))]
        if i % 4 == 0:
            t[r.randrange(len(t))] = r.choice(bad) + r.choice(["", ".", "!!"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    index = toxicity.learn(docs, labels.where("doc_id < 120"))
    found = toxicity.score_documents(with_clashing_columns(docs), index).where("doc_id >= 120").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found) >= 118
    kept = toxicity.keep_clean(with_clashing_columns(docs), labels)
    assert kept.columns == with_clashing_columns(docs).columns and 175 <= kept.count() <= 185


def test_toxicity_knows_rare_words(spark):
    """Sixty words that mark the label, each in four of 480 examples: far too rare for any of them to stand out alone."""
    r, rows, two = random.Random(8), [], ["".join(x) for x in itertools.combinations("abcdefghijkl", 2)]
    for i in range(960):
        t = ["w" + two[r.randrange(50)] for _ in range(30)]
        if i % 2:
            t[r.randrange(30)] = "z" + two[i // 2 % 60]
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(480)], "doc_id long, quality int, toxic int")
    index = toxicity.learn(docs, labels)
    assert len(index.chosen) == 110  # all words of the examples
    found = toxicity.score_documents(docs, index).where("doc_id >= 480").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in found) >= 460


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(5, None, 1), (5, 1, None), (None, None, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        found = toxicity.score_documents(odd_docs, toxicity.learn(odd_docs, labels)).collect()
        assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_documents(no_docs, toxicity.learn(no_docs, odd)).count() == 0


def test_block_max_search_is_exact():
    r = np.random.default_rng(6)
    rows = [(i, np.sort(r.choice(40, r.integers(0, 9), replace=False)), None, int(r.integers(1, 3000))) for i in range(700)]
    rows = [(i, f, r.integers(1, 5, len(f)).astype(float), n) for i, f, _, n in rows]
    index = toxicity.build_index(rows, r.integers(0, 2, 700), np.ones(700), np.arange(40, dtype=np.uint64), r.random(40) * 3, 0.1)
    dense = np.zeros((len(index.votes), 40))
    blocks = index.ceiling.shape[1]
    for cell in range(40 * blocks):
        for j in range(index.row[cell], index.row[cell + 1]):
            dense[index.example[j], cell // blocks] = index.weight[j]
    assert np.allclose((dense**2).sum(axis=1) + index.length**2, 1)
    for i, f, c, n in rows[:120]:
        w, length = index.vector(f, c, n)
        s, at = index.nearest(f, w, length, 10)
        want = dense[:, f] @ w + length * index.length
        assert np.allclose(s, np.sort(want)[::-1][:10]) and np.allclose(want[at], s)


def brute_toxicity(docs, labels, nearest=15):
    """Scores of all docs (doc_id, text) by comparing each with every labelled one; labels: doc_id to 0 or 1."""
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def features(t):
        c = Counter()
        for w in WORD.findall(lower(t)):
            w = w.strip(signs.encode())
            if w:
                c["", w] += 1
            c.update((i, w[:i]) for i in (5, 6, 7, 8) if len(w) > i)
        return c, len(WORD.findall(lower(t)))

    own = {i: features(t or "") for i, t in docs}
    df = Counter(f for c, _ in own.values() for f in c)
    ones = {i for i, y in labels.items() if y and i in own}
    n1, n0 = len(ones), len([i for i in labels if i in own]) - len(ones)
    a, b = Counter(f for i in ones for f in own[i][0]), Counter(f for i in labels if i in own and i not in ones for f in own[i][0])
    weight = {}
    for f in {*a, *b}:
        odds = math.log((a[f] + 0.5) / (n1 + 1)) - math.log((b[f] + 0.5) / (n0 + 1))
        n = n0 + n1
        chi2 = n * (a[f] * (n0 - b[f]) - b[f] * (n1 - a[f])) ** 2 / max((a[f] + b[f]) * (n - a[f] - b[f]) * n1 * n0, 1e-9)
        weight[f] = math.log((1 + len(docs)) / (1 + df[f])) * odds**2 * chi2**2 / (chi2**2 + 4.5**2)

    def vector(i):
        c, n = own[i]
        v = {f: (1 + math.log(k)) * weight[f] for f, k in c.items() if f in weight}
        v["length"] = 0.5 * math.log2(2 + 2 ** round(math.log2(2 + n)) - 2)
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    vectors = {i: vector(i) for i in own}
    merged = {}
    for i in labels:
        if i in own:
            merged.setdefault(frozenset((f, round(x, 9)) for f, x in vectors[i].items() if f == "length" or f in own[i][0]), [vectors[i], [0, 0]])[1][labels[i]] += 1
    share, out = sum(labels.values()) / len(labels), {}
    for i in own:
        s = sorted(((sum(x * e.get(f, 0) for f, x in vectors[i].items()), v) for e, v in merged.values()), key=lambda x: -x[0])[: nearest + 40]
        vote = lambda top: np.array([math.exp(-8 * (1 - min(c, 1.0))) * math.log2(1 + sum(v)) / sum(v) * np.array(v) for c, v in top]).sum(axis=0)
        zero, one = vote(s[:nearest])
        out[i] = (one + 0.05 * share) / (zero + one + 0.05), s[nearest - 1][0] - s[nearest][0] if len(s) > nearest else 1.0
    return out


def test_toxicity_against_brute_force(spark):
    """The query on whole tables: scores agree wherever the last neighbour is told from the next one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    learned = {r.doc_id: int(r.toxic > 0) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    want = brute_toxicity([(r.doc_id, r.text) for r in docs.collect()], learned)
    found = toxicity.op8_toxic_neighbours(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(want) and all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    clear = [r for r in found if want[r.doc_id][1] > 1e-5]
    assert len(clear) > 0.8 * len(found) and max(abs(r.score - want[r.doc_id][0]) for r in clear) < 1e-4


def test_frequencies_are_those_of_all_documents(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 3 else "alpha, (gamma)!") for i in range(30)] + [(31, None)], "doc_id long, text string")
    data, off = textvec.text_buffer(pa.array(["alpha beta gamma"]))
    f = toxicity.feature_counts(data, off)[1]
    n, df = toxicity.document_frequencies(docs, np.sort(f))
    assert n == 31 and sorted(df.tolist()) == [10, 20, 30]


def test_words_lose_all_signs_around_them():
    data, off = textvec.text_buffer(pa.array(["-" * 50 + "word" + "!" * 40 + " ---- a", "..", ""]))
    w = toxicity._bare(textvec.words_of(data, off))
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [b"word", b"", b"a", b""]


def test_blocks_without_a_near_example_are_skipped():
    """Examples of eight vocabularies that share nothing: a query of one of them visits the blocks that hold its own."""
    n, own = toxicity.BLOCK, np.random.default_rng(7)
    rows = [(i, np.sort(own.choice(30, 6, replace=False)) + 30 * (i // n), np.ones(6), 40) for i in range(8 * n)]
    index = toxicity.build_index(rows, np.zeros(8 * n, dtype=int), np.ones(8 * n), np.arange(240, dtype=np.uint64), np.full(240, 3.0), 0.1)
    seen, visit = [], index._visit
    index._visit = lambda f, w, length, blocks: seen.append(len(blocks)) or visit(f, w, length, blocks)
    for _, f, c, n_words in rows[::199]:
        index.nearest(f, *index.vector(f, c, n_words))
    assert sum(seen) < 0.5 * len(rows[::199]) * index.ceiling.shape[1]


def test_lm_counts_against_brute_force(spark, odd_docs):
    docs = with_clashing_columns(odd_docs)
    rows = odd_docs.collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    toks = lambda t: [*WORD.findall(lower(t)), b""]
    for r in rows:
        if not out(r.doc_id):
            count.update(toks(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted((r.doc_id is None, r.doc_id or 0, out(r.doc_id), len(toks(r.text)), sum(count[t] > 0 for t in toks(r.text)), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in toks(r.text)), 6)) for r in rows)
    found = lm.score_documents(docs, block_tokens=500, params=lm.Training(steps=5)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_lm_learns_order_and_is_normalised(spark, no_docs):
    r, cells = np.random.default_rng(3), np.zeros((16, 8))
    for c in range(16):
        cells[c, c % 8] = 900
        cells[c] += r.integers(1, 5, 8)
    lp = lm.train(cells)
    assert np.allclose(np.exp(lp).sum(axis=1), 1, atol=1e-4)
    q = np.log(cells.sum(axis=0) / cells.sum())
    assert (cells * lp).sum() > (cells * q).sum() * 0.5
    assert lm.score_documents(no_docs).count() == 0


def test_lm_contexts_grow_with_the_corpus(spark):
    """Two thousand words of equal frequency, each with a follower of its own: the order of nearly all of them is learned."""
    name = lambda i: "q" + "abcdefghijklmnopqrstuvwxyz"[i // 676 % 26] + "abcdefghijklmnopqrstuvwxyz"[i // 26 % 26] + "abcdefghijklmnopqrstuvwxyz"[i % 26]
    follow = lambda i: (i * 7 + 3) % 2000
    r = random.Random(12)
    starts = [r.randrange(2000) for _ in range(1500)]
    texts = [" ".join(name(x) for x in itertools.accumulate(range(11), lambda x, _: follow(x), initial=i)) for i in starts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r for r in lm.score_documents(docs, params=lm.Training(steps=5)).collect() if r.held_out]
    assert len(found) > 100
    # a uniform guess among the words costs 3.3 for each; a known follower costs far less
    assert sum(r.score for r in found) / sum(r.n_tokens for r in found) > -1.5
    assert np.isclose(lm.with_prior(np.array([3, 1, 0, 0]), np.array([4] * 4), np.array([0.1, 0.2, 0.3, 0.4])).sum(), 1)


def test_lm_scores_against_plain_counts(spark, odd_docs):
    """score from dictionaries of words and pairs, and the context table, whose counts add up to the training tokens."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(i, f"the cat{i % 5} sat on the mat. The dog {i % 3} ran") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: [*WORD.findall(lower(t)), b""]
    learned = docs.where(~lm.held_out(F.col("doc_id")))
    params = lm.Training(steps=7)
    model = lm.fit(learned, lm.word_counts(learned), params)
    word, pair = Counter(), Counter()
    for i, t in rows:
        if not out(i):
            word.update(toks(t))
            pair.update(zip([b"", *toks(t)], toks(t)))
    assert model.cells == model.n == sum(word.values()) and model.v == len(word)
    want = []
    for i, t in rows:
        data, off = textvec.text_buffer(pa.array([t or ""]))
        h, c, at = lm.tokens(data, off)
        symbol = model.vocabulary.symbols(h, c)
        total = 0.0
        for j, (a, b) in enumerate(zip([b"", *toks(t)], toks(t))):
            p = 10 ** float(model.log10[model.vocabulary.contexts(symbol, at)[j], symbol[j]])
            if lm.FREQUENT <= symbol[j] < lm.END:
                p *= (word[b] + 1) / model.class_total[symbol[j] - lm.FREQUENT]
            weight = word[a] ** lm.HEAPS if word[a] else 1
            total += math.log10((pair[a, b] + weight * p) / (word[a] + weight))
        want.append((i is None, i or 0, round(total, 5)))
    found = lm.score_documents(docs, block_tokens=300, params=params).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in found) == sorted(want)


def test_lm_probabilities_of_a_vocabulary_add_up(spark):
    """After any word: all known words, the end and one word that no text has, with what is left of each class for unseen ones."""
    docs = spark.createDataFrame([(i, f"w{i % 9} x{i % 7} y{i % 4}") for i in range(60)], "doc_id long, text string")
    counts = lm.word_counts(docs)
    model = lm.fit(docs, counts, lm.Training(steps=9))
    known = {r.h & (2**64 - 1): (r.cls, r.c) for r in counts.collect()}
    for context in (0, 5, lm.END, 3 * lm.SYMBOLS + 7):
        share = 10 ** model.log10[context].astype(np.float64)
        total = share[lm.END]
        for h, (cls, n) in known.items():
            s = int(model.vocabulary.symbols(np.array([h], dtype=np.uint64), np.array([cls]))[0]) if cls >= 0 else None
            total += 0 if s is None else share[s] if s < lm.FREQUENT else share[s] * (n + 1) / model.class_total[cls]
        # unseen words have one count in each class, and symbols that no word has are theirs too
        frequent = len(model.vocabulary.frequent)
        total += share[frequent : lm.FREQUENT].sum() + sum(share[lm.FREQUENT + c] / model.class_total[c] for c in range(lm.CLASSES))
        assert np.isclose(total, 1, atol=1e-4)


def test_packed_numbers():
    r = np.random.default_rng(1)
    for x in (np.zeros(0), np.array([0, 2**64 - 1]), r.integers(0, 2**63, 1000)):
        x = x.astype(np.uint64)
        assert (lm.unpack(lm.pack(x)) == x).all()


def test_words_and_hashes():
    texts = ["a b", "", "b  a\x0bX", "x" * 3000, "x" * 3001, "ü ü", " lead", "trail "]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = textvec.words_of(data, off)
    own = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
    assert own == [x for t in texts for x in t.encode().split()]
    assert w.counts.tolist() == [len(t.encode().split()) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x.lower() for x in own})
