"""Phrases by compressed position bitmaps, in the manner of SPAM.

Texts are cut into pieces and words, and laid out in shards: every word has a position, and a position without a word
stands between pieces. Each word of a shard has a bitmap of its positions, compressed to the 16-bit blocks that are not empty.
A phrase's bitmap marks its last words: it is shifted by one, ANDed with the bitmaps of the words that share its blocks,
and what is left are the bitmaps of the longer phrases, whose popcounts are their occurrences in the shard. Popcounts are summed
over all shards.

A phrase can be frequent only if its parts are. Shards are read once for words, once for pairs, once for
triples and once for the rest, which grows depth-first, branch by branch. Words, pairs and triples are first counted by
KEY_BITS of a hash alone; tasks know frequent keys by a filter of bounded size. What it lets through wrongly is counted by its words
in the last step and dropped there, so results are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import in_arrow, join_hot, shared_dir, stored, table

#: Words of a phrase; a phrase occurs so often at least; phrases of a language in the report.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Characters of the texts in a shard; a text with more is cut between pieces.
SHARD_CHARS = 4 << 20
#: Bits of a key that is counted. Phrases that share a key only make the filter let more through.
KEY_BITS = 40
#: Bits of a filter for each key in it, and of all of it at most. More keys only make it let more through.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
#: Blocks of a branch that grow together; keys that a task sums up before it hands them on.
BRANCH, HELD = 1 << 16, 1 << 21
#: Parts of a language that are ranked apart before its best are ranked together.
RANKED_APART = 64
UNKNOWN = "und"

_WIDTH = 16
#: Marks between pieces, all as one; words never hold it.
_BREAK = b"."
_TO_BREAK = bytes(_BREAK[0] if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))


# --- shards -------------------------------------------------------------------------------------


def _slices(text: str) -> Iterator[bytes]:
    """The lower-cased (A-Z) bytes of a text, cut between pieces about every SHARD_CHARS bytes."""
    raw = text.encode().lower().translate(_TO_BREAK)
    at = 0
    while len(raw) - at > SHARD_CHARS:
        cut = raw.find(_BREAK, at + SHARD_CHARS)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _bitmaps(owner: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, block, mask) of every block that is not empty, by owner and block; positions rise."""
    order = np.argsort(owner, kind="stable")
    owner, position = owner[order], position[order]
    block = position // _WIDTH
    mask = np.left_shift(1, position % _WIDTH).astype(np.uint16)
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])][: len(owner)])
    return owner[first].astype(np.int32), block[first].astype(np.int32), np.bitwise_or.reduceat(mask, first) if len(first) else mask


_SHARD = pa.schema([
    ("words", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))),
    ("owner", pa.binary()), ("block", pa.binary()), ("mask", pa.binary()),
])


def _shard(texts: list[tuple[str, bytes]]) -> pa.RecordBatch:
    fresh = count(1).__next__
    by_lang: dict[str, dict[bytes, int]] = {}
    streams = []
    for lang, raw in texts:
        known = by_lang.setdefault(lang, defaultdict(fresh, {_BREAK: 0}))
        words = raw.replace(_BREAK, b" . ").split()
        streams.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        streams.append(np.zeros(1, np.int32))
    stream = np.concatenate(streams)
    position = np.flatnonzero(stream)
    words = sorted((i, lang, w) for lang, known in by_lang.items() for w, i in known.items() if i)
    langs, spelt = pa.array([lang for _, lang, _ in words], pa.string()), pa.array([w for _, _, w in words], pa.binary()).cast(pa.string())
    times = np.bincount(stream, minlength=len(words) + 1)[1:]
    listed = pa.StructArray.from_arrays([langs, spelt, pa.array(times)], names=["lang", "word", "n"])
    owner, block, mask = _bitmaps(stream[position] - 1, position)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), listed), *(pa.array([x.tobytes()], pa.binary()) for x in (owner, block, mask))], schema=_SHARD)


def shards(docs: DataFrame) -> DataFrame:
    """The shards of docs (lang, text) as a written table: their words with their counts, and bitmaps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for raw in _slices(text):
                    held.append((lang, raw))
                    size += len(raw)
                    if size >= SHARD_CHARS:
                        yield _shard(held)
                        held, size = [], 0
        if held:
            yield _shard(held)

    filled = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    types = "words array<struct<lang:string,word:string,n:bigint>>, owner binary, block binary, mask binary"
    path = shared_dir(docs.sparkSession)
    # Rows are megabytes long, so the writer looks at its size after each one.
    writer = in_arrow(filled, rows, types).write.option("compression", "zstd").option("parquet.block.size", 16 << 20)
    for kind in ("block", "page"):
        writer = writer.option(f"parquet.{kind}.size.row.check.min", 1).option(f"parquet.{kind}.size.row.check.max", 1)
    writer.parquet(path)
    return docs.sparkSession.read.parquet(path)


# --- filters ------------------------------------------------------------------------------------


@dataclass
class KeyFilter:
    """Bits of keys: every key that was put in passes, and few others."""

    bits: np.ndarray
    size: int

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(self.size - 1)
        return (self.bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


def key_filter(keys: DataFrame) -> KeyFilter:
    """A filter of the column key, sized by the number of rows; at most MOST_BITS bits come to the driver."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_PER_KEY * keys.count() - 1).bit_length()))
    at = F.col("key").bitwiseAND(size - 1)
    found = keys.groupBy(F.shiftright(at, 5).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 31 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    bits[found["place"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return KeyFilter(bits, size)


_BASE = 0x5851F42D4C957F2D


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of phrases from those of a phrase and of the word behind it."""
    with np.errstate(over="ignore"):
        x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + (left >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _text_keys(texts: pa.Array) -> np.ndarray:
    """A key of each text: its bytes as digits of a number in some odd base, modulo 2^64."""
    if not len(texts):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
    powers = [np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(data), base, np.uint64)], dtype=np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    upto = np.r_[np.zeros(1, np.uint64), np.cumsum(data * powers[0][:-1], dtype=np.uint64)]
    return _joined((upto[end] - upto[start]) * powers[1][start], (end - start).astype(np.uint64))


# --- phrases of a shard -------------------------------------------------------------------------


@dataclass
class Phrases:
    """Phrases of a shard: their words (numbers, a row each) and bitmaps; entry k belongs to phrase owner[k]."""

    words: np.ndarray
    owner: np.ndarray
    block: np.ndarray
    mask: np.ndarray

    def times(self) -> np.ndarray:
        return np.bincount(self.owner, np.bitwise_count(self.mask), len(self.words)).astype(np.int64)

    def some(self, keep: np.ndarray) -> Phrases:
        """Those phrases that keep says."""
        entry = keep[self.owner]
        return Phrases(self.words[keep], (np.cumsum(keep) - 1)[self.owner[entry]], self.block[entry], self.mask[entry])


class Shard:
    """The words of a shard and, if it is known which are frequent, the bitmaps of those by word and by block."""

    def __init__(self, row: pa.RecordBatch, frequent: KeyFilter | None):
        self.listed = row.column(0).flatten()
        self.key = _joined(_text_keys(self.listed.field("lang")), _text_keys(self.listed.field("word")))
        if frequent is None:
            return
        owner, block, mask = (np.frombuffer(row.column(i)[0].as_buffer(), kind) for i, kind in ((1, np.int32), (2, np.int32), (3, np.uint16)))
        known = frequent.passes(self.key)[owner]
        owner, block, mask = owner[known], block[known], mask[known]
        self.single = owner, block, mask
        order = np.argsort(block, kind="stable")
        self.word, self.mask = owner[order], mask[order]
        self.start = np.r_[0, np.cumsum(np.bincount(block, minlength=int(block.max(initial=-1)) + 3))]

    def branches(self) -> Iterator[Phrases]:
        """The words as phrases, a branch of whole words at a time."""
        owner, block, mask = self.single
        at = 0
        while at < len(owner):
            to = len(owner) if at + BRANCH >= len(owner) else int(np.searchsorted(owner, owner[at + BRANCH], side="right"))
            words, own = np.unique(owner[at:to], return_inverse=True)
            yield Phrases(words[:, None], own, block[at:to], mask[at:to])
            at = to

    def keys(self, words: np.ndarray) -> np.ndarray:
        key = self.key[words[:, 0]]
        for column in words.T[1:]:
            key = _joined(key, self.key[column])
        return key

    def extended(self, p: Phrases) -> Phrases:
        """All phrases of one word more: shift by a position, AND with each word's bitmap in the same block."""
        low = (p.mask & np.uint16((1 << _WIDTH - 1) - 1)) << np.uint16(1)
        over = (p.mask >> np.uint16(_WIDTH - 1)).astype(bool)
        owner, block, mask = np.r_[p.owner, p.owner[over]], np.r_[p.block, p.block[over] + 1], np.r_[low, np.ones(over.sum(), np.uint16)]
        parts = []
        for at in range(0, len(owner), BRANCH):
            o, b, m = owner[at : at + BRANCH], block[at : at + BRANCH], mask[at : at + BRANCH]
            first, many = self.start[b], self.start[b + 1] - self.start[b]
            entry = np.repeat(np.arange(len(o)), many)
            other = np.arange(len(entry)) + np.repeat(first - np.cumsum(many) + many, many)
            both = m[entry] & self.mask[other]
            hit = np.flatnonzero(both)
            entry = entry[hit]
            parts.append((o[entry], self.word[other[hit]], b[entry], both[hit]))
        owner, word, block, mask = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 3 + (np.zeros(0, np.uint16),)
        pair, own = np.unique(owner.astype(np.int64) * len(self.key) + word, return_inverse=True)
        longer = np.c_[p.words[pair // max(1, len(self.key))], pair % max(1, len(self.key))]
        return Phrases(longer, own, block, mask)

    def spelt(self, words: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """lang and text of phrases."""
        columns = [self.listed.field("word").take(pa.array(c)) for c in words.T]
        return self.listed.field("lang").take(pa.array(words[:, 0])), columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")


def _in_shards(found: DataFrame, grow: Callable[..., Iterator[pa.RecordBatch]], filters: tuple[KeyFilter, ...], types: str) -> DataFrame:
    """What grow makes of a task's shards and the filters of frequent words, pairs and triples, as far as there are some."""
    shared = found.sparkSession.sparkContext.broadcast(filters)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, *more = shared.value or (None,)
        return grow((Shard(batch.slice(i, 1), frequent) for batch in batches for i in range(batch.num_rows)), *more)

    return in_arrow(found, rows, types)


def _keyed(shard: Shard, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    return shard.keys(p.words), p.times()


def _named(shard: Shard, p: Phrases, part_bits: int) -> pa.Table:
    lang, text = shard.spelt(p.words)
    size = pa.array(np.full(len(p.words), p.words.shape[1], np.int32))
    part = pa.array((shard.keys(p.words) >> np.uint64(64 - part_bits)).astype(np.int64))
    return pa.table({"part": part, "lang": lang, "phrase": text, "words": size, "n": pa.array(p.times())})


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their sums."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers, first byte by first byte and so on, so that bytes that are alike lie together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _frequent_keys(found: DataFrame, count_in: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]], filters: tuple[KeyFilter, ...], least: int, part_bits: int) -> KeyFilter:
    """The filter of keys that occur `least` times or more over all shards; count_in gives keys and how often they occur in a shard.

    Tasks sum up what they hold and hand it on by the first part_bits of keys, as compressed differences of sorted keys.
    """
    shift = KEY_BITS - part_bits

    def grow(shards: Iterator[Shard], *known: KeyFilter) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for shard in shards:
            for key, n in count_in(shard, *known):
                held.append(((key & np.uint64((1 << KEY_BITS) - 1)).view(np.int64), n))
                size += len(key)
                if size > HELD:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield _parts(*held.pop())
                        size = 0
        if size:
            yield _parts(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def _parts(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.diff(key >> shift, prepend=-1))
        cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True))
        columns = [pa.array(key[at] >> shift), pa.array([_packed(np.diff(key[a:b], prepend=0)) for a, b in cuts], pa.binary()), pa.array([_packed(n[a:b]) for a, b in cuts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "times"])

    def merged(group: pa.Table) -> pa.Table:
        key, n = _summed(*(np.concatenate([x for x in map(unpack, group.column(c).to_pylist())]) for c, unpack in (("keys", lambda b: np.cumsum(_unpacked(b))), ("times", _unpacked))))
        return pa.table({"key": key[n >= least]})

    dealt = _in_shards(found, grow, filters, "part long, keys binary, times binary")
    return key_filter(stored(dealt.groupBy("part").applyInArrow(merged, "key long")))


def _singles(shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The counts of words are popcounts of their bitmaps, which their shard has stored."""
    yield shard.key, shard.listed.field("n").to_numpy()


def _pairs(shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for branch in shard.branches():
        yield _keyed(shard, shard.extended(branch))


def _frequent_pairs(shard: Shard, branch: Phrases, two: KeyFilter) -> Phrases:
    p = shard.extended(branch)
    return p.some(two.passes(shard.keys(p.words)))


def _triples(shard: Shard, two: KeyFilter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Triples of which both pairs may be frequent."""
    for branch in shard.branches():
        q = shard.extended(_frequent_pairs(shard, branch, two))
        yield _keyed(shard, q.some(two.passes(shard.keys(q.words[:, 1:]))))


def _deep(shard: Shard, two: KeyFilter, three: KeyFilter, longest: int) -> Iterator[Phrases]:
    """From each branch of words down; a phrase grows if the three words at its end may be frequent."""
    for branch in shard.branches():
        yield branch
        p = _frequent_pairs(shard, branch, two)
        yield p
        while len(p.words) and p.words.shape[1] < longest:
            p = shard.extended(p)
            p = p.some(three.passes(shard.keys(p.words[:, -3:])))
            yield p


def _added(tables: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def _spelt_counts(found: DataFrame, filters: tuple[KeyFilter, ...], least: int, longest: int, part_bits: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases that occur `least` times or more, counted by their words.

    Tasks sum up what they hold and hand it on by the first bits of keys, as compressed tables in order of phrases.
    """
    by = ["part", "lang", "phrase", "words"]

    def grow(shards: Iterator[Shard], two: KeyFilter, three: KeyFilter) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for shard in shards:
            for p in _deep(shard, two, three, longest):
                held.append(_named(shard, p, part_bits))
                size += len(p.words)
                if size > HELD // 4:
                    held = [_added(held, by)]
                    size = len(held[0])
                    if size > HELD // 8:
                        yield _tables(held.pop())
                        size = 0
        if size:
            yield _tables(_added(held, by))

    def _tables(counted: pa.Table) -> pa.RecordBatch:
        counted = counted.sort_by([(c, "ascending") for c in by]).combine_chunks()
        part = counted.column("part").to_numpy()
        at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        blobs = []
        for a, b in zip(at, [*at[1:], len(part)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, counted.drop("part").schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(counted.drop("part").slice(a, b - a))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], names=["part", "counted"])

    def merged(group: pa.Table) -> pa.Table:
        counted = _added([pa.ipc.open_stream(blob).read_all() for blob in group.column("counted").to_pylist()], by[1:])
        return counted.filter(pc.greater_equal(counted.column("n"), least)).rename_columns([*by[1:], "f"])

    return _in_shards(found, grow, filters, "part long, counted binary").groupBy("part").applyInArrow(merged, "lang string, phrase string, words int, f long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to `longest` (two at least) words that occur `least` times or more; and, for each
    lang, a row without a phrase whose f is the number of all its words.

    docs needs lang and text; other columns are ignored. A null lang is `und`, a null text is empty. Rows that repeat count each.
    Phrases stay inside pieces and are joined by single blanks. An empty table gives no rows.
    """
    found = shards(docs)
    totals = found.select(F.explode("words").alias("w")).groupBy("w.lang").agg(F.sum("w.n").alias("f")).select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("words"), "f")
    # So many parts of keys that one has no more than two shards have words, on average.
    part_bits = max(8, (found.count() // 2).bit_length())
    frequent = _frequent_keys(found.select("words"), _singles, (), least, part_bits)
    two = _frequent_keys(found, _pairs, (frequent,), least, part_bits)
    three = _frequent_keys(found, _triples, (frequent, two), least, part_bits)
    return stored(totals.unionByName(_spelt_counts(found, (frequent, two, three), least, longest, part_bits)))


# --- collocations -------------------------------------------------------------------------------


def _words(phrase: Column, start: int | Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates in found (from frequent_phrases) that no longer one stands for.

    The cut with the lowest score counts, of equals the first. Products are decimals, exact up to 38 digits.
    """
    totals = found.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = found.filter("words > 0").select("lang", "phrase", "words", "f")
    candidates = known.filter((F.col("words") >= 2) & (F.col("f") >= least)).select("lang", "phrase", "words", F.col("f").alias("a"))
    # A phrase between a candidate and a longer one that occurs as often does so too, so one word more is enough.
    longer = candidates.filter("words > 2").select("lang", "words", F.col("a").alias("b"), F.explode(F.array(_words(F.col("phrase"), 1, F.col("words") - 1), _words(F.col("phrase"), 2, F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("b").isNull() | (100 * F.col("b") < 100 * F.col("a"))).drop("b")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit("l").alias("side"), _words(F.col("phrase"), 1, F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), _words(F.col("phrase"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("part")))
    parts = stored(cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "a", "cut", "s.side", F.struct("lang", "s.part").alias("of")))
    asked = parts.groupBy("of").agg(F.count(F.lit(1)).alias("asked"))
    sized = asked.join(known.select(F.struct("lang", F.col("phrase").alias("part")).alias("of"), "f"), "of")
    cut = join_hot(parts, sized, "of", "asked", parts.count()).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    # One row per lang, as many as there are languages; their sums are not large, whatever the corpus.
    scored = cut.join(totals, "lang")
    score = F.expr("(1000 * cast(a AS decimal(16,0)) * cast(n AS decimal(18,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    scored = scored.withColumn("score", score)
    return scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")


def ranked(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each lang with rank, by score and a from above, then by phrase. Parts of a lang are ranked first, so no task sorts a whole one."""
    order = "score DESC, a DESC, phrase"
    apart = scored.selectExpr("*", f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {RANKED_APART}) ORDER BY {order}) AS rank").filter(F.col("rank") <= top).drop("rank")
    return apart.selectExpr("*", f"row_number() OVER (PARTITION BY lang ORDER BY {order}) AS rank").filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first phrases of two words or more; see frequent_phrases for odd rows."""
    return ranked(collocations(frequent_phrases(docs, least, longest), least), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


def _gram_sql(size: int) -> str:
    return f"SELECT lang, array_to_string(ws[i:i + {size - 1}], ' ') AS phrase, {size} AS words, count(*) AS f FROM (SELECT lang, ws, unnest(generate_series(1, len(ws) - {size - 1})) AS i FROM pieces) GROUP BY lang, phrase HAVING count(*) >= {LEAST}"


OP12_SQL = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
found AS ({" UNION ALL ".join(_gram_sql(k) for k in range(1, LONGEST + 1))}),
candidates AS (SELECT lang, phrase, words, f AS a FROM found WHERE words >= 2),
longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + size - 1], ' ') AS phrase, max(a) AS b
  FROM (SELECT lang, phrase, words, a, size, unnest(generate_series(1, words - size + 1)) AS i FROM (SELECT *, unnest(generate_series(2, words - 1)) AS size FROM candidates WHERE words > 2)) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS rp
  FROM (SELECT c.*, unnest(generate_series(1, words - 1)) AS k FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a) c),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = lp JOIN found y ON y.lang = c.lang AND y.phrase = rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
placed AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best)
SELECT * FROM placed WHERE rank <= {TOP}
"""
