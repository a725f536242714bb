"""Quality by Bradley-Terry pairwise ranking.

Preference pairs are a good and a bad labelled document; the probability that the good one
wins is the logistic function of the difference of their scores, and scores are linear in features of
the text, so the fit is a logistic regression without intercept on feature differences. Documents
are then scored, and a quantile of the training scores is the threshold: the share of bad documents
among the labelled ones.

Features are computed inside tasks from whole texts. All pairs of all labelled documents of the training folds
count: what a document adds to the sums over pairs depends on its own score and on how those of the other label
are spread, so tasks sum documents up by their score, and the sums of the few scores are put together in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexengine.llm.common import in_arrow, small_batches, stored, table

#: Pairs that fit() draws; train() takes all.
PAIRS = 100_000
#: Scores are summed up at multiples of STEP, between the two next to them, and at PLACES different ones at most; a pair's loss is off by a sixteenth of that distance squared at most.
STEP, PLACES = 1 / 64, 8192
#: Newton steps at most, and what keeps the weights of separable documents finite.
STEPS, RIDGE = 40, 1e-4
#: Values that are sorted in the driver to find a place among them, after so many counts have ruled out all others.
SORTED, COUNTS = 10_000, 1000
FOLDS, HELD_OUT = 3, 1

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER, _UPPER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_LOWER[97:123] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_HIGH[128:] = True
_OTHER = ~(_SPACES | _LOWER | _UPPER | _DIGIT | _HIGH)

FEATURES = (
    "lower", "upper", "digit", "high", "space", "newline", "punctuation", "sentence_marks", "other_marks", "log_words", "word_length",
    "distinct_words", "top_word", "distinct_lines", "line_words", "word_ends_in_mark", "upper_words", "longest_word", "distinct_trigrams", "short_words", "empty",
)


def text_features(text: str) -> list[float]:
    """Numbers that describe a text; all are defined, and bounded or logarithmic, for any text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    tally: dict[str, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    sentence = counts[46] + counts[44] + counts[63]
    marks = int(counts[_OTHER].sum())
    return [
        counts[_LOWER].sum() / n,
        counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n,
        counts[_HIGH].sum() / n,
        counts[_SPACES].sum() / n,
        counts[10] / n,
        marks / n,
        sentence / n,
        (marks - sentence) / n,
        np.log1p(len(words)),
        np.log1p(n / w),
        distinct / w,
        max(tally.values(), default=0) / w,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))),
        sum(not x[-1].isalnum() for x in words) / w,
        sum(x.isupper() for x in words) / w,
        np.log1p(max(map(len, words), default=0)),
        len(set(zip(words, words[1:], words[2:], strict=False))) / w,
        sum(len(x) <= 3 for x in words) / w,
        float(not words),
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The features of each text; null texts count as empty. Other columns of a row stay in the JVM."""
    for part in texts:
        yield pa.array([text_features(t.as_py() or "") for t in part], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Ranker:
    """score = logistic(steep * (weights . standardised features - threshold))."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    steep: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.mean)) / np.array(self.scale)).clip(-8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.steep * (self.strength(x) - self.threshold)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 0, rounds: int = 400, ridge: float = 1e-4) -> Ranker:
    """Bradley-Terry by gradient steps with momentum on pairs of a good and a bad document.

    Without a good or without a bad document there are no pairs: all weights are 0 and every
    document gets 1/2, which counts as good.
    """
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not good.any() or good.all():
        return Ranker((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / scale).clip(-8, 8)
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    d = z[draw.choice(better, pairs)] - z[draw.choice(worse, pairs)]
    w, speed = np.zeros(k), np.zeros(k)
    step = 4 / max(1.0, float(np.linalg.norm(d, 2) ** 2) / pairs)
    for _ in range(rounds):
        lost = 1 / (1 + np.exp(d @ w))
        speed = 0.9 * speed + (lost @ d / pairs - ridge * w)
        w = w + step * speed
    s = z @ w
    return Ranker(tuple(mean), tuple(scale), tuple(w), float(np.quantile(s, 1 - good.mean())), 1.0)


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, features) of all labelled documents of the training folds, as a written table; labels that are null are left out.

    Of repeated labels of a document, and of repeated documents, each counts. Ids that are null have no label.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("good"))
    known = known.filter(~held_out(F.col("doc_id")))
    # Features are taken before the join, which so moves no texts.
    described = small_batches(docs).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", features("text").alias("features"))
    return stored(described.join(known, "doc_id").select("good", "features"))


class _Pairs:
    """Sums over all pairs of a good and a bad document, at given weights."""

    def __init__(self, rows: DataFrame, ranker: Ranker, counts: dict[bool, int]):
        self.rows, self.ranker = rows, ranker
        step = self.step = max(STEP, 16 * float(np.abs(ranker.weights).sum()) / PLACES)
        names = ["n", *(f"z{i}" for i in range(len(ranker.weights)))]

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = ranker.standard(_matrix(batch.column(1)))
                at = z @ np.array(ranker.weights) / step
                low = np.floor(at).astype(np.int64)
                # Between two places a document is shared out to both.
                places, share = np.concatenate([low, low + 1]), np.concatenate([low + 1 - at, at - low])
                both = np.tile(np.column_stack([np.ones(len(z)), z]), (2, 1)) * share[:, None]
                keys, inverse = np.unique(places * 2 + np.tile(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), 2), return_inverse=True)
                sums = np.zeros((len(keys), len(names)))
                np.add.at(sums, inverse, both)
                yield pa.RecordBatch.from_pydict({"key": keys, **{name: sums[:, i] for i, name in enumerate(names)}})

        found = in_arrow(rows, tally, ", ".join(["key long", *(f"{name} double" for name in names)])).groupBy("key").agg(*[F.sum(name).alias(name) for name in names]).orderBy("key").toArrow()
        keys, sums = found["key"].to_numpy(), np.column_stack([found[name].to_numpy() for name in names])
        good = keys % 2 == 1
        # Shares of their label: numbers of documents and sums of their features at each place.
        self.at = {g: (keys[good == g] // 2) * step for g in (True, False)}
        self.held = {g: sums[good == g] / counts[g] for g in (True, False)}
        n, z = {g: h[:, 0] for g, h in self.held.items()}, {g: h[:, 1:] for g, h in self.held.items()}
        k = len(ranker.weights)
        self.loss, self.slope, self.cross = RIDGE / 2 * float(np.square(ranker.weights).sum()), -RIDGE * np.array(ranker.weights), np.zeros((k, k))
        self.curve = {True: np.zeros(len(n[True])), False: np.zeros(len(n[False]))}
        for start in range(0, len(n[True]), 256):
            part = slice(start, start + 256)
            apart = self.at[True][part, None] - self.at[False][None, :]
            lost = np.exp(-np.logaddexp(0, apart))
            bend = lost * (1 - lost)
            self.loss += float(n[True][part] @ np.logaddexp(0, -apart) @ n[False])
            self.slope = self.slope + (lost @ n[False]) @ z[True][part] - (n[True][part] @ lost) @ z[False]
            self.cross += z[True][part].T @ bend @ z[False]
            self.curve[True][part] = bend @ n[False]
            self.curve[False] += n[True][part] @ bend
        self.counts = counts

    def newton(self) -> np.ndarray:
        """The step to where the loss would be least if it were as curved everywhere as here."""
        ranker, at, curve, counts = self.ranker, self.at, self.curve, self.counts
        k = len(ranker.weights)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                z, good = ranker.standard(_matrix(batch.column(1))), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                s = z @ np.array(ranker.weights)
                for g in (True, False):
                    own = z[good == g]
                    total += (own * (np.interp(s[good == g], at[g], curve[g]) / counts[g])[:, None]).T @ own
            yield pa.RecordBatch.from_pydict({"place": np.arange(k * k, dtype=np.int64), "part": total.ravel()})

        found = in_arrow(self.rows, moments, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).orderBy("place").toArrow()
        bent = found["part"].to_numpy().reshape(k, k) - self.cross - self.cross.T + RIDGE * np.eye(k)
        return np.linalg.solve(bent, self.slope)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nth_value(values: DataFrame, place: int) -> float:
    """The value at a place, from 0, of the sorted column v; counts of ever smaller ranges lead to it, so few values come to the driver."""
    while True:
        n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
        if low == high:
            return low
        if n <= SORTED:
            return sorted(r.v for r in values.collect())[place]
        part = F.least(F.floor((F.col("v") - low) / (high - low) * COUNTS), F.lit(COUNTS - 1))
        for r in values.groupBy(part.alias("part")).agg(F.count("v").alias("n")).orderBy("part").collect():
            if place < r.n:
                values = values.filter(part == r.part)
                break
            place -= r.n


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fits on all pairs of a good and a bad labelled document of the training folds, see labelled().

    Without a good or without a bad document all weights are 0 and every document gets 1/2, which counts as good.
    """
    rows = labelled(docs, labels)
    k = len(FEATURES)
    one = [F.col("features")[i] for i in range(k)]
    total, good, *told = rows.agg(F.count("good"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)), *map(F.avg, one), *map(F.stddev_pop, one)).first()
    if good in (0, total):
        return Ranker((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 1.0)
    counts = {True: good, False: total - good}
    at = lambda w: _Pairs(rows, Ranker(tuple(told[:k]), tuple(x + 1e-6 for x in told[k:]), tuple(map(float, w)), 0.0, 1.0), counts)
    here = at(np.zeros(k))
    for _ in range(STEPS):
        step, size = here.newton(), 1.0
        gain = float(step @ here.slope)
        # gain is twice what the step promises.
        while gain > 1e-9 and (there := at(np.array(here.ranker.weights) + size * step)).loss > here.loss - 1e-4 * size * gain and size > 1e-3:
            size /= 2
        if gain <= 1e-9 or there.loss >= here.loss:
            break
        here = there
    ranker = here.ranker

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"v": pa.array(ranker.strength(_matrix(batch.column(1))), pa.float64())})

    values = stored(in_arrow(rows, strengths, "v double"))
    # The quantile of the share of bad documents, between the last that counts as bad and the next.
    below, above = nth_value(values, counts[False] - 1), nth_value(values, counts[False])
    return Ranker(ranker.mean, ranker.scale, ranker.weights, below + (above - below) * good / total, 1.0)


def classify(docs: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """The columns in keep, score and predicted; null and empty texts are scored like any other.

    Columns in keep that are named score or predicted give way to those of the classifier. Rows that
    repeat are scored each, an empty table gives no rows.
    """

    @F.arrow_udf(DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            x = np.array([text_features(t.as_py() or "") for t in part], float).reshape(len(part), len(FEATURES))
            yield pa.array(ranker.score(x), pa.float64())

    scored = small_batches(docs).withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored.select(*[c for c in keep if c not in ("score", "predicted")], "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = train(docs, table(spark, sf_dir, "labels"))
    scored = classify(docs, ranker, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
