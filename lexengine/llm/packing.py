"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised inside tasks; documents longer than a sequence are cut into whole sequences and
one shorter first piece. Pieces are dealt by hash into blocks of bounded size; inside each block
best-fit decreasing packs them, and a local search exchanges pieces between underfull sequences
(moves, one for one, two for one, one for two), each time raising the sum of squared fills, until sequences run
empty or nothing improves. Sequences that are still underfull are opened again: the pieces of those of all blocks are dealt
to fewer blocks and packed anew, until one block holds them all or there are no fewer.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import blocks, in_arrow, kept, stored, table

LENGTH, END_ID = 1024, 2
#: Pieces in a block, on average; bins that a local search looks at together.
BLOCK_PIECES, NEIGHBOURS = 16_384, 256
#: Chunks of at most so many characters are remembered; all are forgotten when there are more, or more ids of chunks, than so many.
CACHED_CHARS, CACHED, CACHED_IDS = 24, 300_000, 8_000_000
#: Bytes of texts that are encoded at once, on average; a longer text is encoded whole.
ENCODED_BYTES = 1 << 20

#: A blank before white space (Unicode's, as the pre-tokenizer has it) or the end; elsewhere each blank begins a token of its own.
_ODD_BLANK = " ([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|$)"
#: Unseen chunks that are encoded together.
_TOGETHER = 5_000


class ChunkEncoder:
    """Encodes texts chunk by chunk, a chunk being a blank and what follows up to the next one.

    The tokenizer's pre-tokenizer always starts a token at a blank that is followed by a visible
    character, so each different chunk of a batch is encoded once, and short ones are remembered by number.
    Unseen chunks are encoded side by side; each begins where a token begins with a blank.
    Texts with blanks before white space are encoded whole, and so are chunks in front of a text, as they have no blank.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The tokenizer's alphabet writes a blank as this letter.
        self.blank = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.blank[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        """Chunks have numbers; the ids of all lie one after the other, and number 0 has none."""
        self.numbers: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbered(self, chunks: list[str]) -> np.ndarray:
        """The numbers of different chunks; they hold until the next call."""
        if len(self.numbers) > CACHED or len(self.ids) > CACHED_IDS:
            self._forget()
        found = np.fromiter(map(self.numbers.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(found < 0)
        found[unseen] = len(self.sizes) + np.arange(len(unseen))
        ids, sizes = [self.ids], [self.sizes]
        for at in range(0, len(unseen), _TOGETHER):
            part = [chunks[i] for i in unseen[at : at + _TOGETHER].tolist()]
            own = self._whole([" " + " ".join(part)])[0]
            begin = np.flatnonzero(self.blank[own])
            if len(begin) != len(part):
                raise ValueError(f"{len(part)} chunks begin at {len(begin)} tokens")
            ids.append(own)
            sizes.append(np.diff(begin, append=len(own)))
            first = int(found[unseen[at]])
            self.numbers.update((chunk, first + i) for i, chunk in enumerate(part) if len(chunk) <= CACHED_CHARS)
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end; null texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, " ")
        begin = parts.offsets.to_numpy()
        chunk = parts.flatten().dictionary_encode()
        which = chunk.indices.to_numpy().astype(np.int64)
        odd = pc.match_substring_regex(texts, _ODD_BLANK).to_numpy(zero_copy_only=False)
        # Only chunks that stand behind a blank somewhere are looked up.
        normal = np.repeat(~odd, np.diff(begin))
        normal[begin[:-1]] = False
        asked = np.flatnonzero(np.bincount(which[normal], minlength=len(chunk.dictionary)))
        number = np.zeros(len(chunk.dictionary), np.int64)
        number[asked] = self._numbered(chunk.dictionary.take(pa.array(asked)).to_numpy(zero_copy_only=False).tolist())
        front = self._whole(pc.if_else(pa.array(odd), texts, pc.list_element(parts, 0)).to_pylist())
        which = np.where(normal, number[which], 0)
        which[begin[:-1]] = len(self.sizes) + np.arange(len(front))
        sizes = np.r_[self.sizes, np.fromiter(map(len, front), np.int64, len(front))]
        start = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[which])
        own = np.repeat(start[which] - ends + sizes[which], sizes[which]) + np.arange(ends[-1] if len(ends) else 0)
        return np.concatenate([self.ids, *front])[own], np.r_[0, ends][begin[1:]]


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, so that chunks stay known from task to task; tasks of other stages drop it."""
    # Spark runs a worker per core, so the library's own threads would only get in their way.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(path, lambda: ChunkEncoder(path))


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of n tokens: only the first one may be shorter than length."""
    first = n % length or min(n, length)
    return [(0, first), *[(at, length) for at in range(first, n, length)]] if n else []


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * ENCODED_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids, of each piece of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in _slices(batches):
            ids, ends = enc.encode(batch.column(1))
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            out = {n: [] for n in _PIECES.names}
            raw, begin = memoryview(ids).cast("B"), 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                for number, (start, size) in enumerate(cuts(end - begin, length)):
                    own = raw[4 * (begin + start) : 4 * (begin + start + size)]
                    for n, v in zip(_PIECES.names, (doc_id, number, start, size, zlib.crc32(own), bytes(own) if with_ids else None), strict=True):
                        out[n].append(v)
                begin = end
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    found = in_arrow(docs.select("doc_id", "text"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary", keeps=tokenizer)
    return found if with_ids else found.drop("ids")


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes where it leaves the least room. Bins are lists of piece numbers."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = length, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def least_bins(sizes: np.ndarray, length: int) -> int:
    """A number of bins that no packing goes below.

    For any a up to half a bin: pieces above length - a share a bin with no piece of at least a, pieces above half a bin
    stand in one each, and what the pieces from a to a half exceed the room of the latter by needs further bins.
    """
    s = np.sort(sizes)
    total = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, length / 2, side="right")
    a = np.arange(length // 2 + 1)
    small, large = np.searchsorted(s, a), np.searchsorted(s, length - a, side="right")
    rest = total[half] - total[small] - ((large - half) * length - (total[large] - total[half]))
    return int((len(s) - half + np.maximum(0, -(-rest // length))).max())


class _Near:
    """Bins among which pieces are exchanged: what each could give back, side by side in arrays."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, rooms: np.ndarray):
        self.bins, self.sizes, self.rooms = bins, sizes, rooms
        self._lay_out()

    def _lay_out(self) -> None:
        """What can come back, bin by bin within each kind: nothing, one piece, or two pieces of the same bin."""
        n, held = len(self.bins), [len(b) for b in self.bins]
        owner = np.repeat(np.arange(n), held)
        flat = np.array([i for b in self.bins for i in b], int)
        single, none = self.sizes[flat], np.full(n, -1)
        parts = [(np.zeros(n, int), np.arange(n), none, none), (single, owner, flat, np.full(len(flat), -1))]
        for gap in range(1, max(held, default=0)):
            same = owner[gap:] == owner[:-gap]
            parts.append(((single[gap:] + single[:-gap])[same], owner[gap:][same], flat[gap:][same], flat[:-gap][same]))
        self.back, self.owner, self.one, self.two = map(np.concatenate, zip(*parts, strict=True))
        self.singles = slice(n, n + len(flat))

    def exchange(self, d: int) -> bool:
        """The exchange between bin d and a later one, as full at least, that fills the latter most; whether there is one.

        What is given is larger than what comes back, by no more than the other bin's room, so every exchange raises
        the sum of squared fills.
        """
        rooms = np.where(self.rooms > self.rooms[d], 0, self.rooms)
        rooms[: d + 1] = 0
        limit = rooms[self.owner]
        own = sorted(self.bins[d], key=lambda i: -self.sizes[i])
        pairs = [[i, j] for n, i in enumerate(own) for j in own[n + 1 :]]
        best, found = 0, None
        for gives, backs in (([[i] for i in own], slice(None)), (pairs, self.singles)):
            if not gives or not len(self.back[backs]):
                continue
            gain = np.array([sum(self.sizes[i] for i in give) for give in gives])[:, None] - self.back[backs]
            gain[(gain < 0) | (gain > limit[backs])] = 0
            at = int(gain.argmax())
            row, column = divmod(at, gain.shape[1])
            if gain[row, column] > best:
                best, found = int(gain[row, column]), (gives[row], column + (backs.start or 0))
        if found is None:
            return False
        give, k = found
        b, back = int(self.owner[k]), [int(i) for i in (self.one[k], self.two[k]) if i >= 0]
        self.bins[d], self.bins[b] = [i for i in self.bins[d] if i not in give] + back, [i for i in self.bins[b] if i not in back] + give
        self.rooms[d] += best
        self.rooms[b] -= best
        self._lay_out()
        return True


def improve(bins: list[list[int]], sizes: np.ndarray, length: int, neighbours: int = NEIGHBOURS, seed: int = 0) -> list[list[int]]:
    """Empties underfull bins by exchanges with fuller ones, neighbourhood by neighbourhood.

    Bins are dealt anew to neighbourhoods in each pass. First the emptiest bins give their pieces away; when a pass of that
    changes nothing, all bins exchange with fuller ones in smaller neighbourhoods, which makes new room.
    It ends when that changes nothing either, or when no packing of the pieces has fewer bins (least_bins). Every exchange raises the sum of squared fills, so it does end. Full bins are left alone.
    """
    draw = np.random.default_rng(seed)
    size = sizes.tolist().__getitem__
    fill = lambda b: sum(map(size, b))
    done = [b for b in bins if fill(b) == length]
    open_ = [b for b in bins if fill(b) < length]
    wide = False
    while len(open_) > least_bins(sizes[[i for b in open_ for i in b]], length):
        changed, step = False, neighbours // 8 if wide else neighbours
        open_ = [open_[i] for i in draw.permutation(len(open_))]
        for at in range(0, len(open_), step):
            bins_near = sorted(open_[at : at + step], key=fill)
            fills = list(map(fill, bins_near))
            # The emptiest bins give, as many as could go if the rest were filled; where that ends, all do.
            spare = len(fills) - 1 if wide else len(fills) - -(-sum(fills) // length)
            near = _Near(bins_near, sizes, length - np.array(fills, int))
            for d in range(spare):
                while near.bins[d] and near.exchange(d):
                    changed = True
            open_[at : at + step] = near.bins
        done += [b for b in open_ if b and fill(b) == length]
        open_ = [b for b in open_ if b and fill(b) < length]
        if not changed and wide:
            break
        wide = not changed
    return done + open_


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _packed(cut: DataFrame, length: int, n: int, first: int) -> DataFrame:
    """cut with sequence_id, from first on, offset and the fill of the sequence, packed in n blocks."""
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        sizes = group["length"].to_numpy()
        sequence, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for number, b in enumerate(improve(best_fit(sizes, length), sizes, length)):
            ends = np.cumsum(sizes[b])
            sequence[b], offset[b], fill[b] = number, ends - sizes[b], ends[-1]
        group["sequence_id"] = first + sequence * n + group["block"].to_numpy()
        group["offset"], group["fill"] = offset, fill
        return group.drop(columns="block")

    return stored(dealt.groupBy("block").applyInPandas(one, _PACKED))


def pack(cut: DataFrame, length: int = LENGTH, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and others; each at most length).

    Sequence ids are unique over all blocks. Pieces are dealt to blocks by a hash of their place in
    the table, so rows that repeat spread too. Columns besides doc_id, piece, start, length and ids_crc32 are dropped; join on doc_id and piece to get them back.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut, full, first = cut.select(*names), [], 0
    n = blocks(cut.count(), block_pieces)
    while True:
        found = _packed(cut, length, n, first)
        state = found.agg(F.max("sequence_id").alias("last"), F.sum((F.col("fill") < length).cast("long")).alias("open")).first()
        fewer = blocks(state.open or 0, block_pieces)
        if n == 1 or fewer >= n:
            break
        full.append(found.filter(F.col("fill") == length))
        cut, first, n = found.filter(F.col("fill") < length).select(*names), state.last + 1, fewer
    for rows in full:
        found = found.unionByName(rows)
    return found.drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text; other columns are ignored. Null and empty texts are the end token
    alone. Rows that repeat are packed each; a null doc_id stays null. An empty table gives no rows.
    """
    return pack(stored(pieces(docs, tokenizer, length, with_ids=False)), length, block_pieces)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
