"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased (A-Z) UTF-8 bytes and an end mark. Each byte is eight binary decisions; for each of
the 255 decision nodes there is a context tree over the preceding bytes, up to a depth. Every tree
node estimates its bit by Krichevsky and Trofimov; the weighted probability of a node is half its own
estimate and half the product of its children's, so all depths are mixed.

The estimates depend on counts alone, so the tree is computed from the counts of byte n-grams of the whole
training part, which Spark counts and sums. Nothing is cut off. All contexts that end in the same two
bytes form a subtree, so subtrees are computed apart, in tasks; above them stand 257 contexts at most,
which the driver computes. A subtree of very many n-grams is computed in parts by a third byte, and its top from theirs.
Tasks know the logs of the most frequent n-grams; all others meet theirs in a join.

Beside it stands a unigram model of words with add-one smoothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import in_arrow, join_hot, stored, table

DEPTH = 5
#: Length of the contexts whose subtrees are computed apart, and n-grams of a subtree above which its parts by one byte more are.
APART, SPLIT = 2, 1 << 20
#: n-grams whose logs all tasks know, at most. Others meet theirs in a join.
COMMON_GRAMS = 1 << 19
END = 255
FOLDS, HELD_OUT = 7, 2
#: Words that all tasks know: at most so many, none longer than so many bytes. Others meet their counts in a join.
COMMON_WORDS, COMMON_BYTES = 100_000, 48
#: Entries that a task sums up before it hands them on.
HELD = 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# --- byte n-grams -------------------------------------------------------------------------------


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-grams that end at each byte of each text and its end mark; and how many each text has."""
    pad = bytes([END]) * depth
    buf = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n = len(buf) - depth
    key = np.zeros(n, np.uint64)
    for i in range(depth + 1):
        key = (key << np.uint64(8)) | buf[i : i + n]
    # Between texts stand depth positions that belong to none.
    real = np.ones(n, bool)
    ends = np.cumsum(sizes[:-1] + depth) - depth
    for i in range(depth):
        real[ends + i] = False
    return key[real], sizes


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(n, at)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.diff(np.r_[at, len(key)])


def _lowered(column: pa.Array, step: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(column), step):
        yield at, [(t.as_py() or "").encode().lower() for t in column.slice(at, step)]


def count_grams(train: DataFrame, depth: int) -> DataFrame:
    """(gram, n) over all training texts; gram is a signed 64-bit number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for _, texts in _lowered(batch.column(0)):
                parts.append(_counted(grams(texts, depth)[0]))
                if sum(len(k) for k, _ in parts) > 8 * HELD:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > 4 * HELD:
                        yield _rows(parts.pop())
        if parts:
            yield _rows(_merged(parts))

    def _rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int64)), pa.array(part[1].astype(np.int64))], names=["gram", "n"])

    return in_arrow(train.select("text"), rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# --- the tree -----------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after raising x by the recurrence; x > 0."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    inverse = 1 / y
    square = inverse**2
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives any sequence of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(float), n1.astype(float)
    out = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi)
    return np.where(n0 + n1 > 0, out, 0.0)


def _prefix(byte: np.ndarray, bit: int) -> np.ndarray:
    """The decision node before a bit of a byte: a one and the bits so far."""
    return np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))


class Known:
    """Logs of sorted grams in a table of hashed slots, so that most lookups are one step."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, n: np.ndarray | None = None):
        self.grams, self.logs = grams, logs
        size = 1 << max(10, int(4 * len(grams) - 1).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.slots, self.values = np.full(size, -1, np.int64).view(np.uint64), np.zeros(size)
        # Of grams that share a slot the last one written stays, the most frequent; the others are found by search.
        order = np.arange(len(grams)) if n is None else np.argsort(n, kind="stable")
        at = self.slot(grams[order])
        self.slots[at] = grams[order]
        here = self.slots[at] == grams[order]
        self.values[at[here]] = logs[order][here]

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of each gram, 0 where it is unknown, and the places of unknown ones."""
        at = self.slot(gram)
        found = self.values[at]
        miss = np.flatnonzero(self.slots[at] != gram)
        found[miss] = 0
        if not len(miss) or not len(self.grams):
            return found, miss
        place = np.minimum(np.searchsorted(self.grams, gram[miss]), len(self.grams) - 1)
        here = self.grams[place] == gram[miss]
        found[miss[here]] = self.logs[place[here]]
        return found, miss[~here]


# --- the tree in parts --------------------------------------------------------------------------


@dataclass
class Top:
    """The contexts of less than APART bytes: per depth, by node key, totals, ones and weights.

    split names the subtrees that are computed in parts; node, sorted, and what follows it stand for their contexts of APART bytes. There are
    no more than 2^16 subtrees, of 255 nodes each.
    """

    total: list[np.ndarray]
    ones: list[np.ndarray]
    weight: list[np.ndarray]
    split: list[int]
    node: np.ndarray
    node_total: np.ndarray
    node_ones: np.ndarray
    node_weight: np.ndarray

    def split_values(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals, ones and weights of nodes of subtrees in parts; totals are 0 for contexts without counts."""
        if not len(self.node):
            return np.zeros(len(node)), np.zeros(len(node)), np.ones(len(node))
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        here = self.node[at] == node
        return np.where(here, self.node_total[at], 0), np.where(here, self.node_ones[at], 0), self.node_weight[at]


def _whole_subtrees(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Columns of about size rows, sorted by gram; rows come sorted by subtree, and none is torn."""
    held, rows, enough = [], 0, size
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows >= enough:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            before = np.flatnonzero(columns[0] != columns[0][-1])
            cut = before[-1] + 1 if len(before) else 0
            if cut:
                yield _by_gram([c[:cut] for c in columns])
            held = [[c[cut:] for c in columns]]
            rows -= cut
            enough = max(size, 2 * rows)
    if rows:
        yield _by_gram([np.concatenate(c) for c in zip(*held, strict=True)])


def _by_gram(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[1])
    return [c[order] for c in columns]


@dataclass
class Subtrees:
    """Whole subtrees of contexts that end in the same `apart` bytes, from sorted grams; n is 0 for grams that were not trained."""

    gram: np.ndarray
    n: np.ndarray
    depth: int
    apart: int = APART

    def __post_init__(self) -> None:
        self.grams, self.counts, self.up = {self.depth: self.gram}, {self.depth: self.n.astype(float)}, {}
        for d in range(self.depth, self.apart, -1):
            self.grams[d - 1], self.up[d] = np.unique(self.grams[d] & np.uint64((1 << 8 * d) - 1), return_inverse=True)
            self.counts[d - 1] = np.bincount(self.up[d], self.counts[d], len(self.grams[d - 1]))

    def nodes(self, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """From the deepest depth to `apart`: keys, node of each gram, totals, estimates of a one, weights, weighted logs; and ones."""
        below = None
        for d in range(self.depth, self.apart - 1, -1):
            gram, n = self.grams[d], self.counts[d]
            byte = gram & np.uint64(255)
            node = (gram & ~np.uint64(255)) | _prefix(byte, bit)
            first = np.r_[True, node[1:] != node[:-1]]
            of, start = np.cumsum(first) - 1, np.flatnonzero(first)
            total = np.bincount(of, n)
            ones = np.bincount(of, n * (byte >> np.uint64(7 - bit) & np.uint64(1)))
            own = _log_kt(total - ones, ones)
            weight, weighted = np.ones(len(start)), own
            if below is not None:
                child_start, child_weighted = below
                product = np.bincount(of[self.up[d + 1][child_start]], child_weighted, len(start))
                weight, weighted = _mixed(own, product)
            yield node[start], of, total, ones, weight, weighted
            below = start, weighted

    def logs(self, top: Top) -> np.ndarray:
        """log10 probability of the last byte of each gram after its other bytes."""
        byte = self.gram & np.uint64(255)
        out = np.zeros(len(self.gram))
        for bit in range(8):
            q = np.full(len(self.gram), np.nan)
            place = np.arange(len(self.gram))
            for d, (_, of, total, ones, weight, _) in zip(range(self.depth, self.apart - 1, -1), self.nodes(bit), strict=True):
                at = of[place]
                q = _deeper(q, total[at], ones[at], weight[at])
                if d > self.apart:
                    place = self.up[d][place]
            if self.apart > APART:
                q = _deeper(q, *top.split_values(((self.gram & np.uint64((1 << 8 * (APART + 1)) - 1 & ~255)) | _prefix(byte, bit)).astype(np.int64)))
            for d in range(APART - 1, -1, -1):
                at = ((self.gram & np.uint64((1 << 8 * (d + 1)) - 1 & ~255)) | _prefix(byte, bit)).astype(np.int64)
                q = _deeper(q, top.total[d][at], top.ones[d][at], top.weight[d][at])
            q = np.where(np.isnan(q), 0.5, q)
            out += np.log10(np.where(byte >> np.uint64(7 - bit) & np.uint64(1) == 1, q, 1 - q))
        return out


def _mixed(own: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a node's own estimate, and log of its weighted probability."""
    return 1 / (1 + np.exp(np.clip(product - own, -700, 700))), np.logaddexp(own, product) - math.log(2)


def _deeper(q: np.ndarray, total: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The mixture at nodes above q; a node without a known child gives its own estimate, one without counts gives nothing."""
    own = (ones + 0.5) / (total + 1)
    return np.where(total > 0, np.where(np.isnan(q), own, weight * own + (1 - weight) * q), q)


def _last_bytes(n: int) -> Column:
    """The last n bytes of a gram's context."""
    return F.shiftright("gram", 8).bitwiseAND((1 << 8 * n) - 1)


def large_subtrees(counts: DataFrame, split: int) -> list[int]:
    """The subtrees of more than `split` grams; 2^16 at most."""
    sizes = counts.groupBy(_last_bytes(APART).alias("subtree")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.subtree for r in sizes.filter(F.col("n") > split).select("subtree").collect())


def _by_subtree(counts: DataFrame, split: list[int]) -> DataFrame:
    """Rows of a subtree stand together in one task; those of a split one by its parts, whose numbers are negative."""
    large = counts.sparkSession.createDataFrame([(x,) for x in split], "large long")
    keyed = counts.withColumn("large", _last_bytes(APART)).join(F.broadcast(large.withColumn("parts", F.lit(True))), "large", "left")
    subtree = F.when(F.col("parts"), -1 - _last_bytes(APART + 1)).otherwise(F.col("large"))
    return keyed.select(subtree.alias("subtree"), *counts.columns).repartition("subtree").sortWithinPartitions("subtree")


def _of_both_kinds(columns: list[np.ndarray], depth: int) -> Iterator[tuple[Subtrees, np.ndarray]]:
    """Subtrees as a whole and those in parts, from columns (subtree, gram, n, ...); and where their rows are."""
    for in_parts in (False, True):
        at = np.flatnonzero((columns[0] < 0) == in_parts)
        if len(at):
            yield Subtrees(columns[1][at].astype(np.uint64), columns[2][at], depth, min(depth, APART + in_parts)), at


def fit_top(counts: DataFrame, depth: int = DEPTH, split: list[int] | None = None) -> Top:
    """The top of the tree, from the sums over all subtrees, at most 2^16 rows besides those of split subtrees; depth is more than APART."""
    split = split or []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_subtrees(batches):
            for trees, _ in _of_both_kinds(columns, depth):
                for bit in range(8):
                    *_, (key, _, total, ones, _, weighted) = trees.nodes(bit)
                    node, at = np.unique(key & np.uint64((1 << 8 * trees.apart) - 1), return_inverse=True)
                    sums = [pa.array(np.bincount(at, x)) for x in (weighted, total, ones)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), trees.apart)), pa.array(node.astype(np.int64)), *sums], names=["level", "node", "product", "total", "ones"])

    found = in_arrow(_by_subtree(counts.select("gram", "n"), split), rows, "level long, node long, product double, total double, ones double")
    found = found.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in ("product", "total", "ones")]).toArrow()
    level, node, *sums = (found[c].to_numpy() for c in ("level", "node", "product", "total", "ones"))
    mid = np.flatnonzero(level > APART)
    mid = mid[np.argsort(node[mid])]
    mid_node, (mid_product, mid_total, mid_ones) = node[mid], (x[mid] for x in sums)
    mid_weight, mid_weighted = _mixed(_log_kt(mid_total - mid_ones, mid_ones), mid_product)
    top = Top([], [], [], split, mid_node, mid_total, mid_ones, mid_weight)
    low, parent = level == APART, mid_node & ((1 << 8 * APART) - 1)
    product, total, ones = (np.bincount(node[low], x[low], 1 << 8 * APART) + np.bincount(parent, y, 1 << 8 * APART) for x, y in zip(sums, (mid_weighted, mid_total, mid_ones), strict=True))
    for d in range(APART - 1, -1, -1):
        weight, weighted = _mixed(_log_kt(total - ones, ones), product)
        top.total.insert(0, total)
        top.ones.insert(0, ones)
        top.weight.insert(0, weight)
        if d:
            parent = np.arange(len(total)) & ((1 << 8 * d) - 1)
            product, total, ones = (np.bincount(parent, x, 1 << 8 * d) for x in (weighted, total, ones))
    return top


def gram_logs(counts: DataFrame, top: Top, depth: int = DEPTH) -> DataFrame:
    """(gram, n, log) as a written table, for the grams that are asked for; counts has gram, n and asked, and all trained grams."""
    shared = counts.sparkSession.sparkContext.broadcast(top)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_subtrees(batches):
            for trees, at in _of_both_kinds(columns, depth):
                asked = columns[3][at] > 0
                if asked.any():
                    logs = trees.logs(shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[1][at][asked]), pa.array(columns[2][at][asked]), pa.array(logs[asked])], names=["gram", "n", "log"])

    found = stored(in_arrow(_by_subtree(counts.select("gram", "n", F.col("asked").cast("int").alias("asked")), top.split), rows, "gram long, n long, log double"))
    shared.destroy()
    return found


def least_count(counts: DataFrame, limit: int) -> int:
    """The smallest count from which on at most limit rows have it or more, in steps of an eighth of a power of two."""
    step = F.floor(8 * F.log2("n")).alias("step")
    kept, least = 0, 1
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most")).collect(), reverse=True):
        kept += r.size
        if kept > limit:
            return r.most + 1
    return least


# --- words --------------------------------------------------------------------------------------


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts; word is the bytes of the lower-cased word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for _, texts in _lowered(batch.column(0)):
                for t in texts:
                    for w in t.split():
                        held[w] = held.get(w, 0) + 1
                if len(held) > HELD:
                    yield _rows(held)
                    held = {}
        if held:
            yield _rows(held)

    def _rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return in_arrow(train.select("text"), rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("grams", pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))])


def _unknown(gram: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """Per document a list of its different grams and how often it holds each."""
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    at = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]) if len(gram) else np.zeros(0, int)
    pairs = pa.StructArray.from_arrays([pa.array(gram[at].astype(np.int64)), pa.array(np.diff(np.r_[at, len(gram)]).astype(np.int64))], names=["gram", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(docs + 1)).astype(np.int32)), pairs)


def score_batches(docs: DataFrame, logs_of: tuple[np.ndarray, np.ndarray, np.ndarray], common: dict[bytes, int], depth: int = DEPTH) -> DataFrame:
    """Per document: tokens without the end, the sums over common words and common grams, and the other words and grams.

    logs_of holds the common grams, sorted, their logs and their counts. The rows are a written
    table, so what is broadcast is given up again at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((logs_of, {w: math.log10(n + 1) for w, n in common.items()}))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = Known(*shared.value[0]), shared.value[1]
        for batch in batches:
            for at, texts in _lowered(batch.column(1)):
                key, sizes = grams(texts, depth)
                found, miss = known.find(key)
                scores = np.add.reduceat(found, np.r_[0, np.cumsum(sizes)[:-1]])
                out = {n: [] for n in _SCORED.names}
                out["doc_id"] = batch.column(0).slice(at, len(texts))
                out["score"], out["bytes"] = scores, sizes - 1
                out["grams"] = _unknown(key[miss], np.repeat(np.arange(len(texts)), sizes)[miss], len(texts))
                for t in texts:
                    words = t.split()
                    values = [logs.get(w) for w in words]
                    rare: dict[bytes, int] = {}
                    if None in values:
                        for w, v in zip(words, values, strict=True):
                            if v is None:
                                rare[w] = rare.get(w, 0) + 1
                        values = [v for v in values if v is not None]
                    out["n_tokens"].append(len(words))
                    out["known"].append(len(values))
                    out["logs"].append(math.fsum(values))
                    out["rare"].append([{"word": w, "times": n} for w, n in rare.items()])
                yield pa.RecordBatch.from_pydict(out, schema=_SCORED)

    scored = in_arrow(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, bytes long, known long, logs double, score double, grams array<struct<gram:bigint,times:bigint>>, rare array<struct<word:binary,times:bigint>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    return scored


def score(docs: DataFrame, train: DataFrame, depth: int = DEPTH, common_words: int = COMMON_WORDS, common_grams: int = COMMON_GRAMS, split_above: int = SPLIT) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    docs and train need doc_id and text; other columns are ignored. Null texts count as empty: they
    hold the end alone. Rows that repeat are scored each, and learnt from as often as they stand in
    train. Without training rows all counts are 0 and every bit is even. An empty table gives no rows.
    bits_per_byte is the code length over the text's bytes and its end mark.
    """
    words = stored(count_words(train))
    ends = train.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    short = words.filter(F.octet_length("word") <= COMMON_BYTES)
    # A bound on counts, since a limit would send as many words from every task to the driver.
    common = {bytes(r.word): r.n for r in short.filter(F.col("n") >= least_count(short, common_words)).collect()}
    counts = stored(count_grams(train, depth))
    split = large_subtrees(counts, split_above)
    top = fit_top(counts, depth, split)
    often = gram_logs(counts.withColumn("asked", F.col("n") >= least_count(counts, common_grams)), top, depth).toArrow().sort_by("gram")
    known = often["gram"].to_numpy().astype(np.uint64), often["log"].to_numpy(), often["n"].to_numpy()
    scored = score_batches(docs, known, common, depth)
    # Rare grams, and those that no training text holds.
    wanted = scored.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.times")
    asked = counts.withColumn("asked", F.lit(0)).unionByName(wanted.select("gram").distinct().select("gram", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")))
    asked = stored(asked.groupBy("gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")))
    # Grams that no training text holds can make a subtree large too.
    larger = large_subtrees(asked, split_above)
    logs_of = gram_logs(asked, top if larger == split else fit_top(counts, depth, larger), depth)
    tree = wanted.join(logs_of, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    # Rare words are in few documents each, but a long one may be in very many.
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    sized = rare.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).join(words, "word")
    sums = join_hot(rare, sized, "word", "rows", rare.count()).groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    both = scored.drop("rare", "grams").join(sums, "row", "left").join(tree, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - (F.col("n_tokens") + 1) * F.lit(math.log10(n + v + 1))
    return both.select(
        "doc_id",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        logs.alias("base_score"),
        "score",
        (-F.col("score") / F.lit(math.log10(2)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, docs.filter(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
