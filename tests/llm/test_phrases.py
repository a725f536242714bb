import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexengine.llm import phrases
from tests.llm.brute import lowered

SCHEMA = "doc_id long, lang string, text string, n int, phrase string, rank long"


def plain(rows, least, longest, top):
    """What mine() gives, from lists of words."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    known = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    found = collections.defaultdict(list)
    for (lang, p), a in known.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(other == lang and len(q) > len(p) and b >= a and inside(q) for (other, q), b in known.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in found.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(i, lang, text, 0, "", 1) for i, (lang, text) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in phrases.mine(docs, **how).collect())


def corpus(seed, size):
    draw = np.random.default_rng(seed)
    words = np.array(["a", "A", "b", "c", "é", "dd", ".", "e,", "\n", "\t", "f\x1fg", "Éx", "x\xa0y"])
    return [([None, "und", "en", "fr"][int(draw.integers(4))], None if draw.random() < 0.05 else " ".join(draw.choice(words, int(draw.integers(0, 60))))) for _ in range(size)]


@pytest.mark.parametrize("least", [1, 4])
def test_against_plain_counts(spark, least, monkeypatch):
    rows = corpus(least, 60)
    for values in ({}, {"SHARD_CHARS": 200, "BRANCH": 7, "HELD": 50}):
        for name, value in values.items():
            monkeypatch.setattr(phrases, name, value)
        assert mined(spark, rows, least=least, longest=5, top=40) == plain(rows, least, 5, 40)


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 1024)
    monkeypatch.setattr(phrases.KeyFilter, "passes", lambda self, keys: np.ones(len(keys), bool))
    rows = corpus(7, 20)
    assert mined(spark, rows, least=3, longest=4, top=50) == plain(rows, 3, 4, 50)


def test_edges(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("en", ""), ("en", "a"), ("en", ",;")], least=1) == []
    # A run of equal words overlaps itself; of a phrase and a longer one that is as frequent, the longer one stays.
    rows = [("en", "x " * 5000), (None, "one two three four five. " * 200), (None, "one two three four five. " * 200)]
    found = mined(spark, rows)
    assert found == plain(rows, 100, 5, 2000)
    assert ("und", 1, "one two three four five") == found[-1][:3] and found[-1][3] == 400


def test_scores_pass_64_bits(spark):
    schema = "lang string, phrase string, words int, f long"
    rows = [("en", None, 0, 10**16), ("en", "a b", 2, 10**15), ("en", "a", 1, 3 * 10**15), ("en", "b", 1, 10**15 + 7)]
    assert phrases.collocations(spark.createDataFrame(rows, schema)).first().score == 1000 * 10**15 * 10**16 // (3 * 10**15 * (10**15 + 7))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 200), unique=True, max_size=60), st.integers(1, 5))
def test_bitmaps_hold_their_positions(positions, owners):
    position = np.array(sorted(positions), int)
    owner = np.array([p % owners for p in position], np.int32)
    o, b, m = phrases._bitmaps(owner, position)
    assert [(x, 16 * y + i) for x, y, z in zip(o, b, m, strict=True) for i in range(16) if z >> i & 1] == sorted((int(x), int(p)) for x, p in zip(owner, position, strict=True))


def test_keys_of_texts():
    draw = np.random.default_rng(4)
    texts = ["", "a", "b", "ab", "ba", "é", "a" * 1000, *("".join(chr(97 + int(c)) for c in draw.integers(0, 26, int(draw.integers(1, 12)))) for _ in range(5000))]
    whole = phrases._text_keys(pa.array(texts))
    assert len(set(whole.tolist())) == len(set(texts))
    again = phrases._text_keys(pa.array(["x", *texts[7:], "yy"])[1:-1])
    assert again.tolist() == whole[7:].tolist() and len(phrases._text_keys(pa.array([], pa.string()))) == 0
