import numpy as np

from lexengine.llm import quality
from lexengine.llm.common import table
from tests.llm.brute import crc

SCHEMA = "doc_id long, text string, score string, features int"


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in quality.op10_quality(spark, data).collect()}
    labels = table(spark, data, "labels").collect()
    assert all(scored[r.doc_id].held_out == (crc(r.doc_id) % 3 == 1) for r in labels)
    kept_out = [(scored[r.doc_id].predicted, r.quality) for r in labels if scored[r.doc_id].held_out]
    assert np.mean([p == q for p, q in kept_out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())


def test_ranker_orders_pairs():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 5))
    good = x[:, 1] - x[:, 3] + 0.1 * draw.normal(size=400) > -0.8
    ranker = quality.fit(x, good, pairs=5000)
    s = ranker.score(x)
    assert np.mean(s[good][:, None] > s[~good][None, :]) > 0.98
    assert abs(np.mean(s >= 0.5) - good.mean()) < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "", 0), (1, None, "", 0), (None, "", "", 0), (2, "word " * 50_000, "", 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, quality.train(docs, none), ["doc_id"]).collect()
    assert len(found) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in found)
    one = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, one).threshold == 0.0
    assert quality.classify(docs.limit(0), quality.train(docs, none), ["doc_id"]).count() == 0


def test_fit_is_the_least_loss_of_its_pairs():
    """Newton's method on the same pairs, which shares nothing with the fit but the definition of the loss."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 6)) * [1, 2, 0.5, 1, 3, 1]
    good = x[:, 0] - 0.5 * x[:, 1] + draw.normal(size=500) > 0.2
    pairs, ridge = 20_000, 1e-4
    ranker = quality.fit(x, good, pairs=pairs, rounds=2000, ridge=ridge)
    z = ((x - x.mean(0)) / (x.std(0) + 1e-6)).clip(-8, 8)
    again = np.random.default_rng(0)
    d = z[again.choice(np.flatnonzero(good), pairs)] - z[again.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(6)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(6), p @ d / pairs - ridge * w)
    assert np.allclose(ranker.weights, w, atol=1e-3)
    assert abs(ranker.threshold - np.quantile(z @ w, 1 - good.mean())) < 1e-2


def plain_features(text):
    raw, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
    n, w = max(1, len(raw)), max(1, len(words))
    share = lambda f: sum(map(f, raw)) / n
    kind = lambda b: "s" if b in b" \t\n\x0b\x0c\r" else "l" if 97 <= b <= 122 else "u" if 65 <= b <= 90 else "d" if 48 <= b <= 57 else "h" if b >= 128 else "o"
    marks = share(lambda b: kind(b) == "o")
    sentence = share(lambda b: b in b".,?")
    return [
        *(share(lambda b, k=k: kind(b) == k) for k in "ludhs"), raw.count(b"\n") / n, marks, sentence, marks - sentence, np.log(1 + len(words)), np.log(1 + n / w), len(set(words)) / w,
        max((words.count(x) for x in set(words)), default=0) / w, len(set(lines)) / max(1, len(lines)), np.log(1 + w / max(1, len(lines))), sum(not x[-1].isalnum() for x in words) / w, sum(x.isupper() for x in words) / w,
        np.log(1 + max((len(x) for x in words), default=0)), len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) / w, sum(len(x) < 4 for x in words) / w, 0.0 if words else 1.0,
    ]


def test_features_against_a_plain_version(spark):
    texts = ["", " \n", "The cat. THE CAT!\nThe cat. 12 é,", "a" * 100, *(r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(30).collect())]
    for t in texts:
        assert np.allclose(quality.text_features(t), plain_features(t))


def test_training_takes_all_pairs_of_all_labelled_documents(spark, monkeypatch):
    """Newton's method on all pairs in memory, and the quantile of all scores."""
    draw = np.random.default_rng(5)
    texts = {i: " ".join(draw.choice(["the", "cat", "sat,", "ON", "12", "mat."], int(draw.integers(1, 40)))) for i in range(300)}
    marks = {i: int(t.count("the") + draw.normal() > len(t.split()) / 6) for i, t in texts.items()}
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "SORTED", 5)
    ranker = quality.train(docs, labels)
    ids = [i for i in texts if crc(i) % 3 != 1]
    x, good = np.array([plain_features(texts[i]) for i in ids]), np.array([marks[i] == 1 for i in ids])
    z = ((x - x.mean(0)) / (x.std(0) + 1e-6)).clip(-8, 8)
    d = (z[good][:, None] - z[~good][None, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), p @ d / len(d) - quality.RIDGE * w)
    assert np.allclose(ranker.strength(x), z @ w, atol=0.02)
    assert abs(ranker.threshold - np.quantile(ranker.strength(x), 1 - good.mean())) < 1e-9
