import collections
import math

import numpy as np
import pytest

from lexengine.llm import ctw
from lexengine.llm.common import table
from tests.llm import context_tree
from tests.llm.brute import WORD, crc, lowered

SCHEMA = "doc_id long, text string, n_tokens int, row long"


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def plain(texts, depth):
    """log10 probability of a byte after a context, by recursion over the definition."""
    counts = [collections.Counter() for _ in range(depth + 1)]
    for t in texts:
        s = bytes([255]) * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[d][s[i - d : i], s[i]] += 1

    def node(context, prefix, bits):
        n = [0, 0]
        for byte in range(256):
            if byte >> (8 - bits) == prefix:
                n[byte >> (7 - bits) & 1] += counts[len(context)][context, byte]
        return n

    def weighted(context, prefix, bits):
        own = kt(*node(context, prefix, bits))
        if len(context) == depth:
            return own, own, None
        below = sum(weighted(c, prefix, bits)[1] for c in {bytes([b]) + context for b in range(256)} if sum(node(c, prefix, bits)))
        return own, np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700, below - own)))

    def log10(context, byte):
        total = 0.0
        for bits in range(8):
            prefix, bit, q = byte >> (8 - bits), byte >> (7 - bits) & 1, None
            for d in range(depth, -1, -1):
                c = context[len(context) - d :]
                n = node(c, prefix, bits)
                if not sum(n):
                    continue
                own = (n[1] + 0.5) / (sum(n) + 1)
                if d == depth:
                    q = own
                else:
                    w = weighted(c, prefix, bits)[2]
                    q = w * own + (1 - w) * (own if q is None else q)
            q = 0.5 if q is None else q
            total += math.log10(q if bit else 1 - q)
        return total

    return log10


def tree_of(texts, depth):
    key = ctw.grams(texts, depth)[0]
    return context_tree.fit_tree([ctw._counted(key & np.uint64((1 << 8 * (d + 1)) - 1)) for d in range(depth + 1)])


def test_tree_is_the_weighted_mixture():
    texts = [b"abab ba", b"aab", b"", b"b ab"]
    tree = tree_of(texts, 2)
    tree.prepare()
    log10 = plain(texts, 2)
    for context in (b"ab", b"\xff\xff", b" a", b"zz", b"za"):
        for byte in b"ab z\xff":
            gram = np.array([context[0] << 16 | context[1] << 8 | byte], np.uint64)
            assert tree.predict(gram)[0] == pytest.approx(log10(context, byte), abs=1e-5)
            assert tree.logs_of(gram)[0] == pytest.approx(log10(context, byte), abs=1e-5)


def test_probabilities_add_up():
    tree = tree_of([b"hello world", b"help"], 3)
    for context in (b"\xff\xff\xff", b"hel", b"xyz"):
        grams = np.array([int.from_bytes(context + bytes([b])) for b in range(256)], np.uint64)
        assert (10 ** tree.predict(grams)).sum() == pytest.approx(1, abs=1e-6)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e9])
    assert ctw._log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-10)


def test_scores(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = ctw.score(docs, docs.filter(~ctw.held_out(docs.doc_id)), common_words=50).collect()
    tokens = {r.doc_id: [*WORD.findall(lowered(r.text)), None] for r in docs.collect()}
    counts = collections.Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in found:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 0, 0), (1, None, 0, 0), (None, "Aa aa", 0, 0), (2, "x" * 50_000, 0, 0)], SCHEMA)
    found = ctw.score(rows, rows).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known) for r in found) == [(-1, 3, 3), (1, 1, 1), (1, 1, 1), (2, 2, 2)]
    untrained = ctw.score(rows, rows.limit(0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)
    assert sorted(r.score for r in untrained)[-1] == pytest.approx(-8 * math.log10(2))
    assert ctw.score(rows.limit(0), rows).count() == 0


def test_scores_are_those_of_the_whole_tree(spark):
    """More distinct grams than 2^18, few of them common: every score is that of the unbounded tree."""
    draw = np.random.default_rng(1)
    texts = ["".join(map(chr, draw.integers(32, 127, 2000))) for _ in range(200)] + ["the cat sat on the mat " * k for k in range(1, 40)] + ["żółw", "", None]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], SCHEMA)
    train = docs.filter("doc_id % 7 <> 2")
    raw = [(t or "").encode().lower() for t in texts]
    tree = tree_of([t for i, t in enumerate(raw) if i % 7 != 2], ctw.DEPTH)
    assert len(tree.grams) > 1 << 18
    for common, split in ((0, ctw.SPLIT), (1000, 20), (ctw.COMMON_GRAMS, 0)):
        found = {r.doc_id: r.score for r in ctw.score(docs, train, common_grams=common, split_above=split).collect()}
        assert len(found) == len(texts)
        for i, t in enumerate(raw):
            assert found[i] == pytest.approx(tree.predict(ctw.grams([t], ctw.DEPTH)[0]).sum(), rel=1e-5)


def test_a_hot_subtree_is_split(spark, monkeypatch):
    """A million grams behind the same two bytes come in parts, and scores stay those of the whole."""
    draw = np.random.default_rng(2)
    texts = [bytes(draw.integers(97, 123, 3).tolist()).decode() + "qq" + chr(97 + int(draw.integers(26))) for _ in range(200_000)]
    docs = spark.createDataFrame([(i, " ".join(texts[i * 200 : i * 200 + 200]), 0, 0) for i in range(1000)], SCHEMA)
    counts = ctw.count_grams(docs, ctw.DEPTH).cache()
    assert ctw.large_subtrees(counts, 50_000) == [ord("q") << 8 | ord("q")]
    sizes = ctw._by_subtree(counts, ctw.large_subtrees(counts, 50_000)).groupBy("subtree").count()
    assert sizes.agg({"count": "max"}).first()[0] < 50_000
    some = docs.limit(20)
    want = {r.doc_id: r.score for r in ctw.score(some, docs).collect()}
    found = {r.doc_id: r.score for r in ctw.score(some, docs, split_above=50_000).collect()}
    assert found == pytest.approx(want, rel=1e-9)


def test_a_long_word_in_many_documents(spark):
    """Words beyond COMMON_BYTES meet their counts in a join, also those that all documents hold."""
    long = "w" * 200
    docs = spark.createDataFrame([(i, f"{long} x{i} {long}", 0, 0) for i in range(3000)], SCHEMA)
    found = ctw.score(docs, docs).collect()
    n, v = 3000 * 4, 3002
    want = 2 * math.log10(6001) + math.log10(2) + math.log10(3001) - 4 * math.log10(n + v + 1)
    assert all(r.n_known == 4 and r.base_score == pytest.approx(want, rel=1e-9) for r in found)
