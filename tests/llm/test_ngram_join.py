import random

import numpy as np
from pyspark.sql import functions as F

from lexengine.llm import components, ngram_join
from lexengine.llm.common import table
from lexengine.llm.ngram_join import differ, fine_sketches, sketch_distance
from tests.llm.brute import link_components

SCHEMA = "doc_id long, text string, node string, size int"


def check(spark, rows, **more):
    found = ngram_join.similarity_join(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA), **more)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == link_components(rows)


def test_whole_table(spark):
    check(spark, [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()])


def test_near_copies_of_all_sizes(spark):
    """Chains of edited copies: every step is near the border of the similarity."""
    draw = random.Random(3)
    rows, n = [], 0
    for size in (1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 19, 25, 40, 60, 100, 300):
        for _ in range(6):
            words = [f"w{draw.randrange(10**6)}" for _ in range(size)]
            for _ in range(5):
                rows.append((n, " ".join(words)))
                n += 1
                words = list(words)
                for _ in range(draw.randint(0, 1 + size // 40)):
                    words[draw.choice([0, -1, draw.randrange(len(words))])] = f"v{draw.randrange(10**6)}"
                if draw.random() < 0.4:
                    words.append(f"v{draw.randrange(10**6)}")
    check(spark, rows)


def test_shared_passages_make_busy_keys(spark, monkeypatch):
    """Many documents share one passage; keys of more than two members count as busy."""
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"u{draw.randrange(10**9)}" for _ in range(draw.choice([8, 12, 16, 20, 40]))]
        rows.append((i, " ".join(passage + own)))
    monkeypatch.setattr(ngram_join.across, "__defaults__", (2,))
    check(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "x" * 300_000), (8, "x" * 300_000)]
    check(spark, rows)
    twice = spark.createDataFrame([(4, "a b", "", 1), (4, "a b", "", 1), (None, "a b", "", 1), (9, "c", "", 1)], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id) for r in ngram_join.similarity_join(twice).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert ngram_join.similarity_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_rows_without_an_id(spark):
    """Rows are found by their place, so a thousand of them without an id, or with one id, meet nobody in vain."""
    draw = random.Random(9)
    texts = []
    for _ in range(500):
        words = [f"w{draw.randrange(10**6)}" for _ in range(30)]
        texts += [" ".join(words), " ".join([*words[:-1], "z"])]
    for same in (None, 7):
        docs = spark.createDataFrame([(same, t, str(i), i) for i, t in enumerate(texts)] + [(10**6 + i, t, "", -1) for i, t in enumerate(texts[:4])], SCHEMA)
        found = ngram_join.similarity_join(docs, extra=["size"]).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.component, set()).add(r.size)
        want = link_components(list(enumerate(texts)))
        parts = {}
        for i, (_, c) in want.items():
            parts.setdefault(c, set()).add(i)
        assert sorted(sorted(g - {-1}) for g in groups.values()) == sorted(sorted(p) for p in parts.values())


def test_carried_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "n", 5), (2, "A b", "m", 6), (3, "", "k", 7)], "doc_id long, text string, node string, `least` int").withColumnsRenamed({"least": "place"})
    found = ngram_join.similarity_join(docs.withColumn("component", F.lit("mine")).withColumn("extra", F.lit("x")), extra=["node", "place", "component", "doc_id", "extra"])
    assert sorted(found.columns) == ["component", "component_id", "doc_id", "extra", "n_shingles", "node", "place"]
    assert sorted((r.doc_id, r.node, r.place, r.component_id, r.extra) for r in found.collect()) == [(1, "n", 5, 1, "x"), (2, "m", 6, 1, "x"), (3, "k", 7, 3, "x")]


def test_linked_sets_share_enough_keys():
    """The bound that candidates must reach, on random sets around the border."""
    draw = np.random.default_rng(1)
    for _ in range(300):
        size = int(draw.integers(4, 400))
        a = draw.integers(0, 2**63, size).astype(np.uint64)
        cut = int(draw.integers(0, max(1, size // 9) + 1))
        b = np.concatenate([a[cut:], draw.integers(0, 2**63, int(draw.integers(0, max(1, size // 9) + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * (len(a) + len(b) - shared) or len(a) == shared == len(b):
            continue
        key, node, sizes = ngram_join.index_rows([a, b], np.array([1, 2]))
        both = np.intersect1d(key[node == 1], key[node == 2])
        need = ngram_join.needed(sizes[node == 1].min(keepdims=True), sizes[node == 2].min(keepdims=True))[0]
        assert len(both) >= max(1, need)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 360)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    joined = {x for a, b in links if a != b for x in (a, b)}
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in joined}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components.components(chain).collect()} == {0}
    assert components.components(chain.limit(0)).count() == 0


def test_fine_sketches_never_overstate_a_difference():
    draw = np.random.default_rng(5)
    for n, m, shared in ((1500, 1500, 1400), (5000, 2000, 1900), (90_000, 80_000, 79_000), (3000, 2900, 0)):
        pool = draw.choice(1 << 40, n + m, replace=False).astype(np.uint64)
        x, y = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        a, b = fine_sketches([x, y])
        assert sketch_distance(a, b) == sketch_distance(b, a) <= n + m - 2 * shared
    assert sketch_distance(a, b) > differ(3000, 2900)
    assert fine_sketches([pool[:10], pool[:0]]) == [None, None]


def test_busy_keys_meet_block_by_block(spark, monkeypatch):
    """Documents that consist of common passages only: all their keys are busy, and their members fill several blocks."""
    draw = random.Random(7)
    passages = [[f"p{j}x{i}" for i in range(12)] for j in range(14)]
    rows = []
    for i in range(260):
        words = [w for j in sorted(draw.sample(range(14), 6)) for w in passages[j]]
        rows.append((i, " ".join(words)))
        if draw.random() < 0.3:
            rows.append((1000 + i, " ".join(words[:-1] + ["end"])))
    monkeypatch.setattr(ngram_join.across, "__defaults__", (2,))
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    check(spark, rows)


def test_least_needed_is_a_lower_bound():
    sizes = np.arange(1, 700)
    least = ngram_join.least_needed(sizes)
    for size, low in zip(sizes, least, strict=True):
        partners = np.arange(-(-size * 80 // 100), size * 100 // 80 + 1)
        assert low == ngram_join.needed(np.full(len(partners), size), partners).min()
    assert (ngram_join.least_needed(-sizes) <= 1).all()


def test_a_key_of_very_many_members_meets_in_bounded_memory(spark):
    """100,000 sets under one key make one star, whose tasks hold a batch each; every member is there once or more."""
    one = spark.range(100_000).selectExpr("7L AS key", "id + 5 AS node", "100 AS size", "CAST(IF(id % 4 > 0, id - id % 4 + 5, NULL) AS LONG) AS centre", "IF(id % 4 > 0, 100, NULL) AS centre_size")
    met = ngram_join.meet(one, 80)
    assert met.select("node").distinct().count() == 100_000
    assert met.filter("centre = 5").count() == 25_003 and met.filter("need > 0").count() == 99_999
