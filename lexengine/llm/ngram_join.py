"""Similarity join on word shingles by universe partitioning, exact for any Jaccard threshold.

If two sets of sizes r and s have a Jaccard similarity of at least t, their symmetric difference has
at most H = (r + s) (1 - t) / (1 + t) elements. The universe of shingles is hashed into m segments, m depending
on a band of sizes. With m > H some segment must be the same in both sets; that is what is indexed.

Segments count by their weight: an empty segment counts 0, since two sets that both have nothing there
learn nothing from it; a segment indexed as it is counts 1; a segment indexed together with its
one-deletion neighbourhood (itself without each of its shingles) counts 2, since two sets meet
there unless they differ in two or more places. A band has c segments to spare. Sets with at most
c empty segments index every other one as it is. Sets with more index one-deletion neighbourhoods
of all. Few sets could miss each other even then; they meet under a key of their own. The allocation of m and c minimises the
expected number of index rows of the band.

Sets that meet under a key become candidates as a star around the smallest member, and are
verified on their whole shingle sets. Members of a key that are not connected yet are then
compared across components by small sketches that never overstate a difference, first with the
nearest of other components, then with all; large sets have longer sketches too, which rule out more.
What no sketch can rule out is verified as well. So no link that could join two components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import HOT_PARTS, bloom, in_arrow, join_hot, stored, table
from lexengine.llm.components import components
from lexengine.llm.exact_dedup import located

WORDS = 5
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Each band of sizes ends at this multiple of where it begins.
BAND = 1.4
SKETCH_BITS = 1024
#: Sets of more shingles have a second sketch of about a bit per shingle, of so many bits at most.
FINE_BITS = 1 << 16
#: Keys of more members are busy (see across); their members are compared in blocks of so many.
BUSY, BLOCK = 64, 2048
#: Index rows that a task hands on at once.
ROWS = 100_000
#: Sets verified against one replica of the star's centre.
PER_REPLICA = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit values: xor-shift-multiply rounds."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _byte_values(seed: int) -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64), seed)


def shingle_sets(texts: list[str], seed: int = 0, words: int = WORDS) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit fingerprints of its shingles of lower-cased words.

    A text with fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    raw = [t.encode().lower() for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    begin = np.cumsum([1] + [len(r) + 1 for r in raw])
    base = 0x5851F42D4C957F2D + 2 * seed
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values(seed)[buf] * _powers(len(buf), base), dtype=np.uint64)])
        word = _mix((prefix[end] - prefix[start]) * _powers(len(buf) + 1, pow(base, -1, 1 << 64))[start] + (end - start).astype(np.uint64), seed)
        places = [_mix(np.array([i + 1], np.uint64), seed + 7)[0] | np.uint64(1) for i in range(words)]
        full = max(0, len(word) - words + 1)
        shingle = np.zeros(full, np.uint64)
        for i in range(words):
            shingle += word[i : i + full] * places[i]
        shingle = _mix(shingle, seed)
        first = np.searchsorted(start, begin)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(shingle[a : b - words + 1]))
            elif b > a:
                few = sum((word[a + i] * places[i] for i in range(b - a)), np.uint64(b - a))
                out.append(_mix(np.array([few], np.uint64), seed + 1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    with np.errstate(over="ignore"):
        return tuple(np.array([_mix(np.array([_mix(s, seed).sum(dtype=np.uint64)], np.uint64), seed + len(s))[0] for s in sets], np.uint64).astype(np.int64) for seed in (11, 12))


def _sketch(s: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((_mix(s, 21) >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The parity, for each of SKETCH_BITS buckets, of the number of shingles that fall into it.

    Two sketches never differ in more bits than their sets differ in shingles.
    """
    return [_sketch(s, SKETCH_BITS) for s in sets]


def fine_sketches(sets: list[np.ndarray]) -> list[bytes | None]:
    """Longer sketches of sets with more than SKETCH_BITS shingles; other sets have none."""
    return [_sketch(s, min(FINE_BITS, 1 << (len(s) - 1).bit_length())) if len(s) > SKETCH_BITS else None for s in sets]


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the other's length first."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


# --- allocation ---------------------------------------------------------------------------------


def differ(r: int, s: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of sizes r and s."""
    return (r + s) * (100 - percent) // (100 + percent)


@cache
def band_edges(limit: int, percent: int = PERCENT) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return tuple(edges)


@cache
def allocation(low: int, high: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(H, m, c) of the band of smaller sizes low..high-1: m segments, c of them to spare.

    H holds for every pair whose smaller set is in the band. The cost of c is the expected number
    of index rows of a set: its segments, and its shingles if it has more than c empty ones.
    """
    most = high - 1
    h = differ(most, most * 100 // percent, percent)
    mean = max(1, (low + most) // 2)
    best = None
    for c in range(0, 8 + h // 2):
        m = h + 1 + c
        expected = m * math.exp(-mean / m)
        within, term = 0.0, math.exp(-expected)
        for k in range(c + 1):
            within += term
            term *= expected / (k + 1)
        cost = m + max(0.0, 1 - within) * mean
        if best is None or cost < best[0]:
            best = (cost, c)
    return h, h + 1 + best[1], best[1]


def bands_of(size: int, edges: tuple[int, ...], percent: int = PERCENT) -> list[int]:
    """The bands under which a set is indexed: its own and those of smaller partners that it can have."""
    own = int(np.searchsorted(edges, size, "right")) - 1
    found = [own]
    while own and size * percent <= (edges[own] - 1) * 100:
        own -= 1
        found.append(own)
    return found


def needed(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many keys linked sets of sizes x and y share at least.

    Of the m = H + 1 + c segments of the smaller one's band, at most as many differ as their own sizes
    allow, and at most c are empty in both unless both have more; so the rest is shared. Sizes are
    negative for sets with more than c empty segments, two of which are only sure to share one key.
    """
    small, large = np.minimum(abs(x), abs(y)), np.maximum(abs(x), abs(y))
    edges = band_edges(1 << max(8, int(small.max(initial=1))).bit_length(), percent)
    most = np.array([allocation(a, b, percent)[0] for a, b in zip(edges, edges[1:], strict=False)])
    return np.where((x < 0) & (y < 0), 1, 1 + most[np.searchsorted(edges, small, "right") - 1] - (small + large) * (100 - percent) // (100 + percent))


def least_needed(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many keys a set of each size shares at least with any linked set; sizes are signed as in needed()."""
    own = abs(size)
    edges = np.array(band_edges(1 << max(8, int(own.max(initial=1))).bit_length(), percent))
    found = needed(own, own * 100 // percent, percent)
    band = np.searchsorted(edges, own, "right") - 1
    # Among smaller partners the largest of each band needs the fewest.
    for below in range(int(np.log(100 / percent) / np.log(BAND)) + 3):
        top = np.minimum(edges[np.maximum(band - below + 1, 1)] - 1, own)
        fits = (band >= below) & (top * 100 >= own * percent) & (top > 0)
        found = np.where(fits, np.minimum(found, needed(np.maximum(top, 1), own, percent)), found)
    return np.where(size < 0, np.minimum(found, 1), found)


def index_rows(sets: list[np.ndarray], nodes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, size) of every segment and deletion neighbour under which the sets are indexed.

    size is negative where a set has more empty segments than its band has to spare.
    """
    sizes = np.array([len(s) for s in sets], int)
    edges = band_edges(int(sizes.max(initial=1)), percent)
    by_band: dict[int, list[int]] = {}
    for i, size in enumerate(sizes.tolist()):
        if size:
            for b in bands_of(size, edges, percent):
                by_band.setdefault(b, []).append(i)
    keys, owners, shorts = [], [], []
    with np.errstate(over="ignore"):
        for b, members in by_band.items():
            h, m, c = allocation(edges[b], edges[b + 1], percent)
            if not h:
                continue  # only equal sets link, and those are one node
            tokens = np.concatenate([sets[i] for i in members])
            of = np.repeat(np.arange(len(members)), sizes[members])
            spread = _mix(tokens, 100 + b)
            segment = of * m + ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            segment, spread = segment[order], _mix(spread[order], 5)
            at = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            total = np.add.reduceat(spread, at)
            place = segment[at]
            salt = _mix((place % m).astype(np.uint64) + np.uint64(b << 32), 6)
            keys.append(_mix(total + salt, 8))
            owners.append(np.array(members)[place // m])
            filled = np.bincount(place // m, minlength=len(members))
            short = m - filled > c
            shorts.append(short[place // m])
            if short.any():
                per = np.diff(np.r_[at, len(segment)])
                mine = short[of[order]]
                less = (np.repeat(total, per) - spread + np.repeat(salt, per))[mine]
                # A segment of one shingle has nothing left; empty segments are not indexed.
                several = np.repeat(per, per)[mine] > 1
                keys.append(_mix(less, 8)[several])
                owners.append(np.array(members)[of[order][mine][several]])
                shorts.append(np.ones(len(owners[-1]), bool))
                rest = np.flatnonzero(short & (2 * filled < h + 1))
                keys.append(np.full(len(rest), _mix(np.array([b], np.uint64), 9)[0], np.uint64))
                owners.append(np.array(members)[rest])
                shorts.append(np.ones(len(rest), bool))
    key = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
    owner = np.concatenate(owners).astype(int) if owners else np.zeros(0, int)
    short = np.concatenate(shorts) if shorts else np.zeros(0, bool)
    return key, nodes[owner], np.where(short, -sizes[owner], sizes[owner])


# --- Spark --------------------------------------------------------------------------------------

def _batches(column: pa.Array, step: int = 200) -> Iterator[tuple[int, list[str]]]:
    for at in range(0, len(column), step):
        yield at, [t.as_py() or "" for t in column.slice(at, step)]


def keyed(docs: DataFrame, seed: int, percent: int) -> DataFrame:
    """doc_id, place, extra, n_shingles, the two keys (node, check), the sketches and least_needed() of each document's set."""
    schema = "doc_id long, n_shingles long, node long, check long, sketch binary, fine binary, least int"
    for field in docs.select("place", "extra").schema:
        schema += f", {field.name} {field.dataType.simpleString()}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batches(batch.column(1)):
                sets = shingle_sets(texts, seed)
                node, check = set_keys(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(node), pa.array(check), pa.array(sketches(sets), pa.binary()), pa.array(fine_sketches(sets), pa.binary()), pa.array(least_needed(np.array([len(s) for s in sets], np.int64), percent).astype(np.int32)), *[c.slice(at, len(texts)) for c in batch.columns[2:]]], names=["doc_id", "n_shingles", "node", "check", "sketch", "fine", "least", "place", "extra"])

    return in_arrow(docs.select("doc_id", "text", "place", "extra"), rows, schema)


_INDEX = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("centre", pa.int64()), ("centre_size", pa.int32())])


def index(docs: DataFrame, seed: int, percent: int) -> DataFrame:
    """The index rows (key, node, size, centre, centre_size) of all sets. A set that a task has already seen is not indexed again.

    Of the members of a key in one batch only the smallest goes on to meet those of other batches, with a null centre;
    the others have met it as their centre already. So however many sets share a key, it has a row per batch to meet.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts = []
            for _, texts in _batches(batch.column(0)):
                sets = shingle_sets(texts, seed)
                nodes = set_keys(sets)[0]
                new = []
                for i, n in enumerate(nodes.tolist()):
                    if n not in seen:
                        seen.add(n)
                        new.append(i)
                parts.append(index_rows([sets[i] for i in new], nodes[new], percent))
            if not parts:
                continue
            key, node, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((node, key))
            key, node, size = key[order], node[order], size[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            members = np.diff(np.r_[at, len(key)])
            # All members of a key with several, with their centre; and each key's centre alone.
            met = np.flatnonzero(np.repeat(members, members) > 1)
            which, centre = np.r_[met, at], np.r_[np.repeat(at, members)[met], at]
            alone = np.arange(len(which)) >= len(met)
            for i in range(0, len(which), ROWS):
                one, two, no = which[i : i + ROWS], centre[i : i + ROWS], alone[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(key[one]), pa.array(node[one]), pa.array(size[one].astype(np.int32)), pa.array(node[two], mask=no), pa.array(size[two].astype(np.int32), mask=no)], schema=_INDEX)

    return in_arrow(docs.select("text"), rows, "key long, node long, size int, centre long, centre_size int")


_MET = pa.schema([("key", pa.int64()), ("centre", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("need", pa.int32())])


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Sorted batches, cut so that rows of one key stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(by).to_numpy()
        if key[0] == key[-1] and held and held[0].column(by)[0].as_py() == key[0]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _fit(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(abs(x), abs(y)) * 100 >= np.maximum(abs(x), abs(y)) * percent


def meet(indexed: DataFrame, percent: int) -> DataFrame:
    """Members of each key with two or more nodes, as stars: (key, centre, node, size, need).

    A task holds a batch of rows and the centre of the last key, whatever the number of members.
    """

    def star(key: np.ndarray, centre: np.ndarray, centre_size: np.ndarray, node: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        need = np.where(_fit(size, centre_size, percent) & (node != centre), needed(size, centre_size, percent), 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(centre), pa.array(node), pa.array(size), pa.array(need)], schema=_MET)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
        for batch in batches:
            if not batch.num_rows:
                continue
            met = batch.filter(pc.is_valid(batch.column("centre")))
            yield star(*(met.column(n).to_numpy() for n in ("key", "centre", "centre_size", "node", "size")))
            fresh = batch.filter(pc.is_null(batch.column("centre")))
            if not fresh.num_rows:
                continue
            # The centre of the last key stands in front of the batch again.
            key, node, size = (np.concatenate([x, fresh.column(n).to_numpy()]) for x, n in zip(last, ("key", "node", "size"), strict=True))
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            centre = np.repeat(at, np.diff(np.r_[at, len(key)]))
            # The same set may come from several tasks.
            other = node != node[centre]
            shared = np.zeros(len(key), bool)
            shared[centre[other]] = True
            if len(last[0]) and told:
                shared[0] = False
            tell = other | (shared & (centre == np.arange(len(key))))
            yield star(key[tell], node[centre[tell]], size[centre[tell]], node[tell], size[tell])
            told = bool(other[at[-1] :].any()) or (told and at[-1] == 0 and len(last[0]) > 0)
            last = [x[at[-1] : at[-1] + 1] for x in (key, node, size)]

    where = F.when(F.col("centre").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node"))
    dealt = indexed.repartition(where).sortWithinPartitions("key", "node")
    return in_arrow(dealt, rows, "key long, centre long, node long, size int, need int")


def across(met: DataFrame, labels: DataFrame, nodes: DataFrame, verified_pairs: DataFrame, percent: int, nearest: bool, busy: int = BUSY) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components, may be similar by their sketches and were not verified yet.

    With `nearest`, of each node's pairs in a batch of keys only the one with the closest sketch.

    Keys of more than `busy` members, of different components, are left out where that is safe: a pair's
    number of keys to share, less the busy keys that both have at most, is still positive. So a busy
    key makes pairs only of members for which no other key need exist; members for which there is another one with any
    partner are left out of it. The others are dealt to blocks of about BLOCK members, and every two blocks meet in a task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "group"):
            n = run.num_rows
            if not n:
                continue
            group, node, size, label, hot, members, own, twin = (run.column(c).to_numpy() for c in ("group", "node", "size", "label", "hot", "members", "block", "twin"))
            bits = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
            at, step = np.arange(n), 0
            found = []
            while len(at):
                # Members of a group stand side by side: compare each with the one so many places on.
                step += 1
                at = at[at + step < n]
                at = at[group[at] == group[at + step]]
                other = at + step
                fits = (label[at] != label[other]) & (~twin[at] | (own[at] != own[other])) & _fit(size[at], size[other], percent)
                i, j = at[fits], other[fits]
                if len(i):
                    safe = (members[i] <= busy) | (needed(size[i], size[j], percent) - np.minimum(hot[i], hot[j]) < 1)
                    i, j = i[safe], j[safe]
                    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                    close = apart <= (abs(size[i]) + abs(size[j])).astype(np.int64) * (100 - percent) // (100 + percent)
                    if close.any():
                        found.append((i[close], j[close], apart[close]))
            if not found:
                continue
            i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            if nearest:
                order = np.argsort(apart, kind="stable")
                ends = np.concatenate([node[i[order]], node[j[order]]])
                best = np.unique(ends, return_index=True)[1] % len(order)
                i, j = i[order[best]], j[order[best]]
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    labelled = met.join(labels, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("label"))
    # Only keys whose members are not all connected have anything to compare.
    open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo <> hi")
    open_ = stored(open_.select("key", "members"))
    total = open_.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first().n
    labelled = stored(join_hot(labelled, open_, "key", "members", max(total, HOT_PARTS * busy)))
    hot = stored(labelled.filter(F.col("members") > busy).groupBy("node").agg(F.count(F.lit(1)).alias("hot"), F.min("size").alias("smallest")))
    zero = F.lit(0).cast("long")
    # Sets that may have no key but busy ones in common with a linked set; a negative size shares a key with its like only.
    exposed = hot.join(nodes.select("node", "least"), "node").filter("smallest < 0 OR least <= hot").drop("smallest")
    several = labelled.filter(F.col("members") > busy).join(exposed, "node").filter("size < 0 OR least <= hot").drop("least")
    several = stored(several)
    blocks = several.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    several = stored(join_hot(several, blocks, "key", "n", max(total, HOT_PARTS * busy)))
    several = several.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    several = several.withColumn("group", F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))).withColumn("twin", F.col("block") != F.col("with"))
    few = labelled.filter(F.col("members") <= busy).join(hot.drop("smallest"), "node", "left").withColumns({"hot": F.coalesce("hot", zero), "block": zero, "twin": F.lit(False), "group": F.xxhash64("key", zero, zero)})
    columns = ["group", "node", "size", "label", "hot", "members", "block", "twin"]
    dealt = few.select(*columns).unionByName(several.select(*columns)).join(nodes.select("node", "sketch"), "node").repartition("group").sortWithinPartitions("group", "node")
    pairs = in_arrow(dealt, rows, "a long, b long").distinct()
    return pairs.join(verified_pairs, ["a", "b"], "left_anti")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their fine sketches do not rule out; pairs without two of them stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                both = x is not None and y is not None
                stay.append(not both or sketch_distance(x["fine"], y["fine"]) <= differ(x["n_shingles"], y["n_shingles"], percent))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    known = nodes.filter("fine is not null").select("node", F.struct("n_shingles", "fine").alias("s"))
    found = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("x")), "a", "left")
    found = found.join(known.select(F.col("node").alias("b"), F.col("s").alias("y")), "b", "left")
    return in_arrow(found.select("a", "b", "x", "y"), rows, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, seed: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough.

    Texts meet by pair: those of a's partners and a's own, once for every PER_REPLICA partners, so that
    no task gets all partners of one centre. Sets are made from the texts where they meet.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, None
        for batch in batches:
            a, salt, role, node = (batch.column(n).to_numpy() for n in ("a", "salt", "role", "node"))
            found: list[tuple[int, int]] = []
            for at, texts in _batches(batch.column("text")):
                sets = shingle_sets(texts, seed)
                # Places are hashed, so another text may have the same.
                same = set_keys(sets)[0] == node[at : at + len(texts)]
                for i in np.flatnonzero(same):
                    k = at + i
                    if role[k] == 0:
                        group, centre = (a[k], salt[k]), sets[i]
                    elif group == (a[k], salt[k]):
                        both = np.sort(np.concatenate([centre, sets[i]]))
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        if 100 * shared >= percent * (len(both) - shared):
                            found.append((int(a[k]), int(node[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    sized = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_REPLICA).alias("replicas"))
    members = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), F.col("replicas")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    centres = sized.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("replicas") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    asked = members.unionByName(centres).join(nodes.select("node", "place"), "node")
    asked = stored(asked)
    # A comparison, though it always holds, is what lets the planner build a Bloom filter of what is asked.
    texts = docs.select("place", "text").join(asked.filter("role >= 0"), "place").drop("place")
    with bloom(docs.sparkSession):
        dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
        return stored(in_arrow(dealt, rows, "a long, b long").distinct())


def similarity_join(docs: DataFrame, percent: int = PERCENT, extra: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id; with extra columns also those and component.

    docs needs doc_id and text; other columns are ignored. Columns in extra that are named like one of the result give way. Null texts count as empty; documents
    without words have an empty set and are linked with nothing, so each is its own component.
    Documents with equal sets are one node of the graph. component_id is the smallest doc_id
    reachable by links; a null doc_id is smaller than none and never a component's name unless
    all its documents have none. An empty table gives no rows.

    Only components are returned. Links inside a component that is connected already are not
    verified, so neither pairs nor a number of links comes out. component tells components apart
    whatever their doc_ids; it is null for documents without words.
    """
    seed = 0
    extra = [c for c in extra if c not in ("doc_id", "n_shingles", "component_id", "component")]
    # Rows are found again by their place in the files, as doc_ids may repeat or be missing; extra columns travel as one.
    own = F.struct(*extra) if extra else F.lit(None).cast("int")
    docs = located(docs.select("doc_id", "text", own.alias("extra"))).withColumn("place", F.xxhash64("loc")).drop("loc")
    while True:
        slim = stored(keyed(docs, seed, percent))
        nodes = stored(slim.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine"), F.first("n_shingles").alias("n_shingles"), F.first("least").alias("least")))
        if nodes.filter("lo <> hi").isEmpty():
            break
        seed += 1  # two different sets share a key: other fingerprints
    met = stored(meet(index(docs, seed, percent), percent))
    # First each node meets the one centre with which it shares most keys, if enough; that connects nearly all.
    shared = met.filter("need > 0").groupBy("centre", "node").agg(F.count(F.lit(1)).alias("keys"), F.max("need").alias("need")).filter("keys >= need")
    first = stored(shared.groupBy(F.col("node").alias("b")).agg(F.max_by("centre", F.struct("keys", "centre")).alias("a")))
    links = verified(docs, nodes, first, seed, percent)
    labels = components(links)
    done = first
    for nearest in (True, False):
        open_ = stored(across(met, labels, nodes, done, percent, nearest))
        more = stored(plausible(open_, nodes, percent))
        done = done.select("a", "b").unionByName(open_)
        if not more.isEmpty():
            links = links.unionByName(verified(docs, nodes, more, seed, percent))
            labels = components(links)
    return _labelled(slim, nodes, labels, extra)


def _labelled(slim: DataFrame, nodes: DataFrame, labels: DataFrame, extra: Sequence[str]) -> DataFrame:
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = join_hot(named, names, "component", "n", nodes.count()).select("node", "component", "component_id", "copies")
    full = join_hot(slim.filter("n_shingles > 0").select("doc_id", "n_shingles", "node", "extra"), stored(ids), "node", "copies", slim.count())
    empty = slim.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "extra")
    more = ["component", *[F.col("extra")[c].alias(c) for c in extra]] if extra else []
    return full.select(empty.columns).unionByName(empty).select("doc_id", "n_shingles", "component_id", *more)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))
