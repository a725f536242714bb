import collections
import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexengine.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, vector long"


def plain(rows):
    """What encode() gives, number by number."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 4))
    cut = []
    for _, v, _ in kept:
        ints = [math.floor(1024 * x) if abs(x) < 2**60 else 1024 * int(x) for x in v] + [0] * (4 * width - len(v))
        cut.append([ints[p * width : (p + 1) * width] for p in range(4)])
    books = [[row[p] for row in cut[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            held = collections.defaultdict(list)
            for row in cut:
                held[near(row[p], book)[1]].append(row[p])
            for e, own in held.items():
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found, sums = [], collections.Counter()
    for (i, _, label), row in zip(kept, cut, strict=True):
        got = [near(row[p], books[p]) for p in range(4)]
        found.append((i, label, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
        sums[label] += found[-1][3]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    long = lambda n: n if n < 2**63 else None
    return sorted(((i, label, code, long(e), long(sums[label]), sha) for i, label, code, e in found), key=repr)


def encoded(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vc.encode(df.repartition(3)).collect()), key=repr)


def test_against_plain(spark):
    draw = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in draw.normal(0, 0.2, 8)], [None, 1, 2][int(draw.integers(3))]) for i in draw.permutation(400)]
    rows += rows[:3]
    assert encoded(spark, rows) == plain(rows)


def test_edges(spark):
    assert encoded(spark, []) == []
    odd = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf")], None)]
    assert encoded(spark, odd) == []
    # Null ids, lengths that differ, an empty vector, ties and repeats.
    rows = [*odd, (None, [0.5, 0.25, -0.1, 0.0, 3.0], None), (5, [], 7), (5, [0.1], 7), (6, [0.5] * 4, None), (6, [0.5] * 4, None), (7, [-0.0004] * 8, 7)]
    assert encoded(spark, rows) == plain(rows)
    assert len(encoded(spark, [(1, [], None)])) == 1


def test_numbers_beyond_64_bits(spark):
    rows = [(1, [1e300, 0.0, 1.0, -1e18], 1), (2, [-1e300, 5.0, 1.5, 1e17], 1), (3, [1e200, 0.1, 2.0, 3.0], 2)]
    rows += [(4 + i, [float(i), 0.3, 1.0, 1e9 * i], 3) for i in range(300)]
    found = encoded(spark, rows)
    assert found == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), max_size=20))
def test_annulus_holds_the_nearest_and_ties_go_to_the_first(book, parts):
    x, b = np.array(parts, np.int64).reshape(-1, 3), np.array(book, np.int64)
    code, distance = vc.nearest(x, b)
    want = [min((int(((row - c) ** 2).sum()), e) for e, c in enumerate(b)) for row in x]
    assert list(zip(distance.tolist(), code.tolist(), strict=True)) == want


def test_the_annulus_prunes(monkeypatch):
    draw = np.random.default_rng(1)
    book = draw.normal(0, 1, (256, 4)) * np.exp(draw.normal(0, 2, (256, 1))) * 1024
    x = (book[draw.integers(0, 256, 1000)] * 1.01).astype(np.int64)
    compared = []
    real = np.nonzero
    monkeypatch.setattr(vc.np, "nonzero", lambda asked: compared.append(int(asked.sum())) or real(asked))
    vc.nearest(x, book.astype(np.int64))
    assert sum(compared) < 0.25 * 256 * 1000
