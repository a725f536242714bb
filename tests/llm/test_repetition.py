import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexengine.llm import repetition
from lexengine.llm.common import table
from tests.llm.brute import SPACES, WORD

SCHEMA = "doc_id long, text string, n_words int, kept string, before long"


def plain(text, least):
    """n_repeat_words, covered words and characters, the longest repeat and all maximal repeats, by comparing all pairs of places."""
    words = WORD.findall(text)
    n = len(words)
    inside, again, longest = set(), set(), 0
    holders = collections.defaultdict(set)
    for i in range(n):
        for j in range(i + 1, n):
            size = 0
            while j + size < n and words[i + size] == words[j + size]:
                size += 1
            longest = max(longest, size if size >= least else 0)
            for at in (i, j):
                if size >= least:
                    inside.update(range(at, at + size))
                if size >= 5:
                    again.update(range(at, at + size))
            if size >= least and (not i or words[i - 1] != words[j - 1]):
                holders[tuple(words[i : i + size])].update((i, j))
    spans = [m.span() for m in WORD.finditer(text)]
    repeats = []
    for gram in holders:
        at = [i for i in range(n - len(gram) + 1) if tuple(words[i : i + len(gram)]) == gram]
        repeats.append((spans[at[0]][0], spans[at[0] + len(gram) - 1][1], len(at)))
    return len(again), len(inside), sum(len(words[i]) for i in inside), longest, sorted(repeats)


TEXTS = st.lists(st.sampled_from(["a", "b", "é", "\n", " ", "a b a b a", "#c", "\x1f", "\xa0"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.integers(1, 9))
def test_against_all_pairs(texts, least):
    found = repetition._measured(texts, [t.encode().split() for t in texts], least, True)
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        assert found["n_words"][i] == len(words) and found["word_chars"][i] == sum(map(len, words))
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        assert found["n_dup_lines"][i] == sum(x in lines[:k] for k, x in enumerate(lines))
        got = (found["n_repeat_words"][i], found["covered_words"][i], found["covered_chars"][i], found["longest_repeat"][i])
        repeats = sorted((r["start"], r["end"], r["times"]) for r in found["repeats"][i])
        assert (*got, repeats) == plain(t, least)


def test_suffixes_are_sorted():
    ids = np.random.default_rng(0).integers(0, 3, 2000)
    ends = np.array([700, 700, 701, 2000])
    array = repetition.SuffixArray(ids, ends)
    keys = [(int(np.searchsorted(ends, i, side="right")), *ids[i : ends[np.searchsorted(ends, i, side="right")]].tolist()) for i in array.order]
    assert keys == sorted(keys)
    lcp = array.lcp(1)
    for k in range(1, 2000):
        shared = next((x for x, (a, b) in enumerate(zip(keys[k - 1], keys[k], strict=False)) if a != b), min(len(keys[k - 1]), len(keys[k])))
        assert lcp[k] == max(0, shared - 1)


def test_edges(spark):
    long = " ".join(map(str, range(60_000)))
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [
        (1, None, 1, "x", 7), (1, None, 1, "x", 7), (None, "", 1, None, None), (2, "word " * 50_000, None, "", 0), (3, long, 0, "", 0),
        (4, f"{passage} {long} {passage}", 0, "", 0), (5, f"{passage[:-4]} {long} {passage[:-4]}", 0, "", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = repetition.judge(docs, spans=True).collect()
    assert len(found) == len(rows) and {r.before for r in found} == {0, 7, None}
    by = {r.doc_id: r for r in found}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[1].repeats == []
    assert by[2].n_words == 50_000 and by[2].n_repeat_words == 50_000 and by[2].longest_repeat == 49_999 and by[2].base_failed
    assert by[3].kept and by[3].longest_repeat == 0
    # One repeat of 51 words in a long text is too long, one of 50 is not.
    assert not by[4].base_failed and by[4].longest_repeat == 51 and not by[4].kept and len(by[4].repeats) == 1
    assert by[5].longest_repeat == 50 and by[5].kept
    assert repetition.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01"])
def test_good_documents_stay(spark, data):
    found = repetition.op11_quality_rules(spark, data)
    judged = found.join(table(spark, data, "labels"), "doc_id").filter("quality = 1").agg({"doc_id": "count"}).first()[0]
    stay = found.join(table(spark, data, "labels"), "doc_id").filter("quality = 1 AND kept").count()
    assert stay >= 0.98 * judged
