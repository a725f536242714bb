"""Forgiving search, full text, joins by time, chains, order statistics and the key table, against plain versions."""

import collections
import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexengine.operators import closure, fulltext, fuzzy, increment, orderstats, temporal
from lexengine.session import scratch_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- forgiving search ---------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_typos_against_all_pairs(spark):
    draw = random.Random(0)
    words = ["".join(draw.choice("abé") for _ in range(draw.randrange(0, 7))) for _ in range(80)]
    long = "".join(draw.choice("abcdefgh") for _ in range(60))
    words += [long, long[:30] + long[32:], "x" + long[:-1], long[:20] + "zz" + long[20:], long[::-1], None, "ab", "ab"]
    queries, known = words[::2], words[1::2]
    for distance in (1, 2):
        index = fuzzy.typo_index(spark.createDataFrame([(w,) for w in known], "key string"), distance=distance)
        found = fuzzy.typo_matches(spark.createDataFrame([(w,) for w in queries], "query string"), index, distance=distance)
        assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
        want = {(a, b, n) for a in queries for b in known if a and b and (n := edits(a, b)) <= distance}
        rows = [tuple(r) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_suggestions_are_the_nearest(spark):
    words = spark.createDataFrame([("hello", 5), ("hallo", 2), ("help", 9), ("hello", 3), ("hollow", None), (None, 1), ("", 0)], "key string, rank int")
    queries = spark.createDataFrame([("helo",), ("",), (None,), ("zzzzzz",)], "query string")
    found = [tuple(r) for r in fuzzy.typo_suggestions(queries, words, top=3).orderBy("place").collect()]
    assert found == [("helo", 1, "hello", 1, 3), ("helo", 2, "help", 1, 9), ("helo", 3, "hallo", 2, 2)]
    assert fuzzy.typo_suggestions(queries.limit(0), words).count() == 0


def by_wildcards(pattern, key):
    regex, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern) and pattern[at + 1] in "*?\\":
            regex, at = regex + re.escape(pattern[at + 1]), at + 2
            continue
        regex, at = regex + {"*": ".*", "?": "."}.get(c, re.escape(c)), at + 1
    return re.fullmatch(regex, key, re.S) is not None


def test_wildcards_do_not_send_the_index(spark, tmp_path, monkeypatch):
    """The keys of an index look small to the planner, which would broadcast all their grams."""
    keys = [f"Name#{i:05}" for i in range(300)]
    spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(f"{tmp_path}/keys")
    index = fuzzy.gram_index(spark.read.parquet(f"{tmp_path}/keys"))
    patterns = spark.createDataFrame([("*12",), ("N?me*9?",), ("*#0*",)], "pattern string")
    found = fuzzy.wildcard_matches(patterns, index)
    assert all("Generate" not in part for part in plan_of(found).split("BroadcastExchange")[1:])
    want = {(p.pattern, k) for p in patterns.collect() for k in keys if by_wildcards(p.pattern, k)}
    assert {tuple(r) for r in found.collect()} == want
    monkeypatch.setattr(fuzzy, "SENT", 0)
    found = fuzzy.wildcard_matches(patterns, index)
    assert "BroadcastExchange" not in plan_of(found)
    assert {tuple(r) for r in found.collect()} == want


def test_wildcards_against_regular_expressions(spark):
    draw = random.Random(1)
    keys = ["".join(draw.choice("aabé%_*?\\ ") for _ in range(draw.randrange(0, 9))) for _ in range(120)] + ["", None, "a\nb"]
    patterns = ["".join(draw.choice(["a", "b", "é", "*", "?", "%", "_", "\\*", "\\?", "\\\\"]) for _ in range(draw.randrange(0, 6))) for _ in range(120)]
    patterns += ["*", "?", "??*", "", None, "a*b", "*a", "a*", "*\\**", "ab", "*zzz*"]
    index = fuzzy.gram_index(spark.createDataFrame([(k,) for k in keys], "key string"))
    found = fuzzy.wildcard_matches(spark.createDataFrame([(p,) for p in patterns], "pattern string"), index)
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    want = {(p, k) for p in patterns for k in keys if p is not None and k is not None and by_wildcards(p, k)}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    path = scratch_dir(spark)
    fuzzy.write_postings(index, path, 3)
    postings = spark.read.parquet(path)
    for p in ("*a", "a*b", "?", "\\**", "zzz", "*é*a*"):
        one = fuzzy.wildcard_lookup(postings, p)
        assert {r.key for r in one.collect()} == {k for k in keys if k is not None and by_wildcards(p, k)}
    assert "EqualTo(gram" in plan_of(fuzzy.wildcard_lookup(postings, "*ab*"))


def test_rhymes(spark):
    sounds = [("cat", "K AE1 T"), ("bat", "B AE1 T"), ("combat", "K AA1 M B AE2 T"), ("the", "DH AH0"), ("a", "AH0"), ("hm", "HH M"), ("", None), ("dog", "D AO1 G")]
    found = {tuple(r) for r in fuzzy.rhymes(spark.createDataFrame(sounds, "word string, phones string")).collect()}
    assert found == {("cat", "AE T", 2), ("bat", "AE T", 2), ("combat", "AE T", 2), ("the", "AH", 1), ("a", "AH", 1)}


def sound_cost(a, b):
    """The least cost of an alignment of phones, by the definition."""
    alike = {p: i for i, phones in enumerate(fuzzy.ALIKE) for p in phones}
    row = [2 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], 2 * i
        for j, y in enumerate(b, 1):
            swap = 0 if x == y else 1 if alike[x] == alike[y] else 2
            before, row[j] = row[j], min(row[j] + 2, row[j - 1] + 2, before + swap)
    return row[-1]


def test_sounds_against_aligning_all(spark):
    draw = random.Random(11)
    phones = [p for group in fuzzy.ALIKE for p in group]
    some = [[draw.choice(phones[:12] if draw.random() < 0.7 else phones) for _ in range(draw.randrange(1, 6))] for _ in range(160)]
    words = [(f"w{i}", " ".join(p + draw.choice(["", "0", "1"]) for p in x)) for i, x in enumerate(some)]
    queries = [(f"q{i}", t) for i, (_, t) in enumerate(words[:60])] + [("none", None), ("empty", " "), ("odd", "XX")]
    bare = {w: re.sub("[0-9]", "", t).split() for w, t in [*words, *queries[:60]]}
    for cost in (1, 2, 4):
        found = fuzzy.sound_alikes(spark.createDataFrame(queries, "query string, phones string"), spark.createDataFrame([*words, ("no", None)], "word string, phones string"), cost)
        want = {(q, w, c) for q, _ in queries[:60] for w, _ in words if (c := sound_cost(bare[q], bare[w])) <= cost}
        assert {tuple(r) for r in found.collect()} == want


# --- full text ----------------------------------------------------------------------------------


def bm25(texts, queries, top):
    words = {d: re.findall(r"[^\W\d_]+", (t or "").lower()) for d, t in texts}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, t in queries:
        asked = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        scored = []
        for d, ws in words.items():
            parts = [round(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean))), 6) for w in asked if (n := ws.count(w))]
            if parts:
                scored.append((-round(sum(parts), 6), d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed, size, words):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(words) if draw.random() < 0.8 else f"rare{chr(97 + draw.randrange(26))}" for _ in range(draw.randrange(0, 60)))) for i in range(size)]


def test_phones_are_coded_once_for_each_word(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("elt(id % 3 + 1, 'cat', 'kat', 'dogs') AS word").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words")).distinct()
    coded, asked = spark.sparkContext.accumulator(0), spark.createDataFrame([("cat", "K AE T")], "query string, phones string")
    phones = {"cat": "K AE T", "kat": "K AE D", "dogs": "D AO G Z"}

    @F.udf("string")
    def said(word):
        coded.add(1)
        return phones[word]

    found = fuzzy.sound_alikes(asked, words.withColumn("phones", said("word")))
    assert sorted(map(tuple, found.collect())) == [("cat", "cat", 0), ("cat", "kat", 1)]
    assert coded.value == 3


def test_best_texts_against_scoring_all(spark):
    texts = [*corpus(2, 300, ["a", "b", "c", "dé", "E", "f"]), (900, None), (901, "")]
    queries = [(0, "a b rareq"), (1, "raree"), (2, "none"), (3, None), (4, "A a DÉ f c b e rarez rarea"), (5, "a")]
    index = fulltext.text_index(spark.createDataFrame(texts, "doc long, text string"))
    asked = spark.createDataFrame(queries, "query long, text string")
    for top in (1, 7):
        found = sorted(tuple(r) for r in fulltext.best_texts(index, asked, top).collect())
        assert [(q, p, d, round(s, 6)) for q, p, d, s in found] == bm25(texts, queries, top)
    assert fulltext.best_texts(index, asked.limit(0)).count() == 0
    empty = fulltext.text_index(spark.createDataFrame([], "doc long, text string"))
    assert fulltext.best_texts(empty, asked).count() == 0


def test_few_texts_are_scored(spark):
    """A text that holds the whole passage sets a bound that common words cannot reach."""
    texts = corpus(3, 2000, ["a", "b", "c"])
    passage = "pone ptwo pthree pfour pfive psix a b c"
    texts += [(10_000 + i, f"{passage} x{chr(97 + i)}") for i in range(5)]
    index = fulltext.text_index(spark.createDataFrame(texts, "doc long, text string"))
    asked = spark.createDataFrame([(0, passage, "pone")], "query long, text string, term string")
    terms = asked.select("query", F.explode(fulltext.tokens(F.col("text"))).alias("term")).join(index.terms, "term").withColumn("bound", F.col("idf") * F.col("most"))
    assert fulltext._candidates(index, terms, 3).count() == 5
    assert {r.doc for r in fulltext.best_texts(index, asked, 3).collect()} <= {10_000 + i for i in range(5)}


def test_scores_are_summed_where_a_text_lies(spark):
    """Pairs of a query and a text are as many as both multiplied; none is shuffled before it is known to be among the best of its task."""
    texts = [*corpus(5, 200, ["a", "b", "c"]), (7, "a rareb"), (None, "a")]
    asked = [(q, f"a b c rare{chr(97 + q)}") for q in range(9)]
    index = fulltext.text_index(spark.createDataFrame(texts, "doc long, text string"))
    found = fulltext.best_texts(index, spark.createDataFrame(asked, "query long, text string"), 4)
    assert not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan_of(found))
    # Parts of scores are dealt out by text, and pairs are made behind that.
    assert "REPARTITION_BY_NUM" in plan_of(found)
    # Texts that share a doc are one text.
    whole = [(d, f"{t} a rareb" if d == 7 else t) for d, t in texts[:200]]
    assert sorted((q, p, d, round(s, 6)) for q, p, d, s in found.collect()) == bm25(whole, asked, 4)


def test_words_of_no_phrase_stay(spark):
    """The index of places is not shuffled as a whole, only the words that a step looks for; texts in several batches."""
    texts = [(i, "a b " * (i % 3) + f"c d{chr(97 + i % 26)}") for i in range(2500)]
    index = fulltext.positions(spark.createDataFrame(texts, "doc long, text string"))
    found = fulltext.phrase_places(index, spark.createDataFrame([(0, "a b c dc"), (1, "b a")], "phrase long, text string"))
    assert "LeftSemi" in plan_of(found)
    want = {(0, i, 2 * (i % 3) - 2) for i in range(2500) if i % 3 and i % 26 == 2} | {(1, i, 1) for i in range(2500) if i % 3 == 2}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_phrases_against_slices(spark):
    texts = [*corpus(4, 150, ["a", "b", "c"]), (900, None), (901, "a"), (902, "a a a a a")]
    phrases = [(0, "a b"), (1, "a a a"), (2, "rareb"), (3, "c, RAREA b"), (4, ""), (5, None), (6, "a b zzz"), (7, "b c a b"), (8, "a")]
    index = fulltext.positions(spark.createDataFrame(texts, "doc long, text string"))
    found = sorted(tuple(r) for r in fulltext.phrase_places(index, spark.createDataFrame(phrases, "phrase long, text string")).collect())
    want = []
    for p, t in phrases:
        asked = re.findall(r"[^\W\d_]+", (t or "").lower())
        for d, text in texts:
            ws = re.findall(r"[^\W\d_]+", (text or "").lower())
            want += [(p, d, i) for i in range(len(ws) - len(asked) + 1) if asked and ws[i : i + len(asked)] == asked]
    assert found == sorted(want)


# --- time ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_against_scanning(spark, strict):
    draw = random.Random(5)
    left = [(i, draw.choice(["hot", "hot", "x", None]), draw.choice([None, *range(40)])) for i in range(300)]
    right = [(i, draw.choice(["hot", "hot", "x", "y", None]), draw.choice([None, *range(3, 40)])) for i in range(200)]
    a, b = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "rid long, k string, t long")
    want = {}
    for i, k, t in left:
        before = [(u, j) for j, l, u in right if None not in (k, t, u) and l == k and (u < t or u == t and not strict)]
        want[i] = max(before)[1] if before else None
    for ranges in (1, 2, 13, None):
        found = temporal.as_of(a, b, "k", "t", ["rid"], strict, ranges)
        assert found.columns == ["id", "k", "t", "rid"]
        rows = found.collect()
        assert len(rows) == len(left) and {r.id: r.rid for r in rows} == want
    assert temporal.as_of(a, b.limit(0), "k", "t", ["rid"], strict, 3).filter("rid IS NOT NULL").count() == 0


def test_as_of_timestamps_and_repeats(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    a = spark.createDataFrame([(1, day(3)), (1, day(3)), (1, day(1))], "k int, t timestamp")
    b = spark.createDataFrame([(1, day(2), "x", 1), (1, day(2), "y", 0)], "k int, t timestamp, v string, w int")
    assert sorted((r.t.day, r.v, r.w) for r in temporal.as_of(a, b, "k", "t", ["v", "w"], ranges=4).fillna({"v": ""}).collect()) == [(1, "", None), (3, "y", 0), (3, "y", 0)]


def test_overlaps_against_all_pairs(spark):
    draw = random.Random(6)

    def some(n):
        rows = []
        for i in range(n):
            a = draw.randrange(-500, 500)
            rows.append((i, draw.choice(["hot", "hot", "x", None]), draw.choice([None, a, a, a]), draw.choice([None, a - 1, *(a + draw.choice([0, 1, 2, 3, 7, 8, 100, 2000]) for _ in range(6))])))
        return rows

    left, right = some(150), some(150)
    schema = "id long, k string, a long, b long"
    want = sorted((x[0], y[0]) for x in left for y in right if None not in (*x, *y) and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    for cell_rows in (10_000, 3):
        found = temporal.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "a", "b", cell_rows)
        assert sorted((r.l.id, r.r.id) for r in found.collect()) == want


# --- chains -------------------------------------------------------------------------------------


def test_chains_against_walking(spark):
    draw = random.Random(7)
    rows = [(i, draw.randrange(i) if i and draw.random() < 0.97 else None) for i in range(400)]
    rows += [(1000 + i, 999 + i if i else None) for i in range(70)]  # one long chain
    rows += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2004, 2003), (2005, 2005), (3000, 77_777), (None, 3), (5, None)]
    links = {}
    for i, p in rows:
        if i is not None:
            links[i] = min(x for x in (links.get(i), p) if x is not None) if (links.get(i), p) != (None, None) else None
    want = {}
    for i in links:
        path, at = [i], links[i]
        while at is not None and at in links and at not in path:
            path.append(at)
            at = links[at]
        want[i] = (None, None, True, None) if at in links else (path[-1], len(path) - 1, False, path[::-1])
    found = closure.chains(spark.createDataFrame(rows, "id long, parent_id long"))
    got = {r.node: (r.root, r.depth, r.cyclic, r.path) for r in found.collect()}
    assert got == want
    pairs = {(r.node, r.ancestor, r.distance) for r in closure.ancestors(found).collect()}
    assert pairs == {(i, a, len(path) - 1 - k) for i, (_, _, cyclic, path) in want.items() if not cyclic for k, a in enumerate(path[:-1])}
    assert closure.chains(spark.createDataFrame([], "id long, parent_id long")).count() == 0


def test_paths_of_chains_take_few_joins(spark, monkeypatch):
    rows = [(f"{c}-{i:02}", f"{c}-{i - 1:02}" if i else "nowhere" if c % 2 else None) for c in range(40) for i in range(c)] + [("a", "b"), ("b", "a")]
    want = {(f"{c}-{i:02}", tuple(f"{c}-{k:02}" for k in range(i + 1))) for c in range(40) for i in range(c)} | {("a", None), ("b", None)}
    tables = []
    stored = closure._stored
    monkeypatch.setattr(closure, "_stored", lambda df: tables.append(stored(df)) or tables[-1])
    nodes = spark.createDataFrame(rows, "id string, parent_id string")
    small = closure.chains(nodes)
    # The longest chain has 39 nodes: six rounds and one in which none ends, the nodes and the large trees.
    assert len(tables) <= 9
    monkeypatch.setattr(closure, "TREE", 20)
    monkeypatch.setattr(closure, "ENTRIES", 7)
    for found in (small, closure.chains(nodes)):
        got = [(r.node, r.path and tuple(r.path)) for r in found.select("node", "path").collect()]
        assert len(got) == len(rows) and set(got) == want


# --- order statistics ---------------------------------------------------------------------------


def test_quantiles_against_sorting(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["hot", "hot", "b", None]), draw.choice([None, 0, -1, 5, 2**62, -(2**63), 2**63 - 1, draw.randrange(-1000, 1000)])) for _ in range(600)]
    rows += [("one", 7), ("none", None), *[("same", 3)] * 50]
    groups = collections.defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    want = sorted(((g, q, len(v), sorted(v)[max(1, math.ceil(len(v) * q - 1e-9)) - 1]) for g, v in groups.items() for q in shares), key=repr)
    df = spark.createDataFrame(rows, "g string, v long")
    for small in (10, 100_000):
        assert sorted((tuple(r) for r in orderstats.quantiles(df, "g", "v", shares, small).collect()), key=repr) == want
    assert orderstats.quantiles(df.limit(0), "g", "v", shares).count() == 0


def test_sketches_are_near(spark):
    rows = spark.range(40_000).selectExpr("id % 2 AS g", "(id * 7919) % 40009 AS v")
    parts = orderstats.sketches(rows.filter("v < 20000"), "g", "v").unionByName(orderstats.sketches(rows.filter("v >= 20000"), "g", "v"))
    merged = parts.groupBy("g").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    for r in merged.select("g", "n", orderstats.sketch_quantile(F.col("sketch"), 0.5).alias("x")).collect():
        below = rows.filter((F.col("g") == r.g) & (F.col("v") <= r.x)).count()
        assert abs(below / r.n - 0.5) < 0.02


def test_quantiles_send_no_groups(spark):
    """Nothing that has a row for each group is broadcast; values of which all bits, some or none agree."""
    for values in ([5], [7, 300, -(2**63), 2**63 - 1, 0, -1], [1000, 1001, 1255]):
        rows = [(g, values[(g * i) % len(values)]) for g in range(1, 20) for i in range(1, g + 1)]
        found = orderstats.quantiles(spark.createDataFrame(rows, "g long, v long"), "g", "v", [0.0, 0.25, 0.5, 1.0], small=8)
        assert "BroadcastExchange" not in plan_of(found)
        want = set()
        for g in range(1, 20):
            own = sorted(v for h, v in rows if h == g)
            want |= {(g, q, len(own), own[max(1, math.ceil(len(own) * q - 1e-9)) - 1]) for q in (0.0, 0.25, 0.5, 1.0)}
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want


# --- the key table ------------------------------------------------------------------------------


def test_inserts_touch_their_ranges_only(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randrange(1, 5)))
    rows = [(word(), i, f"v{i}") for i in range(300)] + [(None, -1, "x")]
    schema = "key string, id long, v string"
    path = scratch_dir(spark)
    table = increment.create(spark.createDataFrame(rows, schema), path, 6)
    held = {(k, i): v for k, i, v in rows if k is not None}

    def same(prefix=""):
        found = increment.lookup(spark, increment.opened(spark, path), prefix)
        assert sorted(tuple(r) for r in found.select("key", "id", "v").collect()) == sorted((k, i, v) for (k, i), v in held.items() if k.startswith(prefix))
        return found

    same()
    for n in range(3):
        batch = [("a" + word(), 1000 * n + i, f"w{n}") for i in range(5)] + [(rows[n][0], rows[n][1], f"again{n}"), (None, 5, "x")]
        before = set(spark.read.parquet(f"{path}/data").inputFiles())
        table = increment.insert(table, spark.createDataFrame(batch, schema))
        held |= {(k, i): v for k, i, v in batch if k is not None}
        assert set(spark.read.parquet(f"{path}/data").inputFiles()) == before
        for prefix in ("", "a", "ab", "é", "zz", rows[n][0]):
            same(prefix)
    touched = [r for r, b in enumerate(table.batches) if b]
    assert 0 < len(touched) < len(table.bounds)
    before = table.versions
    table = increment.compact(spark, table)
    assert [r for r, v in enumerate(table.versions) if v != before[r]] == touched and not any(table.batches)
    assert increment.compact(spark, table) == table == increment.opened(spark, path)
    for prefix in ("", "a", "b"):
        same(prefix)
    # A lookup reads files of the ranges that may hold the prefix alone.
    assert len(same("a").inputFiles()) < len(same().inputFiles())


def test_an_empty_key_table_takes_inserts(spark):
    schema = "key string, id long"
    table = increment.create(spark.createDataFrame([], schema), scratch_dir(spark), 4)
    assert increment.lookup(spark, table).count() == 0
    table = increment.insert(table, spark.createDataFrame([("b", 1), ("a", 2)], schema))
    table = increment.insert(table, spark.createDataFrame([], schema))
    assert [r.id for r in increment.lookup(spark, increment.compact(spark, table)).orderBy("key").collect()] == [2, 1]
