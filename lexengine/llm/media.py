"""Media columns: signature sniffing with Aho-Corasick and format validators.

One automaton holds the magic bytes of all known formats. It walks once over a blob; every place
where magic bytes occur goes to the validator of that format, which checks the structure and works
out the length from the lengths that the format itself declares. What passes is carved; a declared
type that does not match what the blob is gets corrected.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexengine.llm.common import BATCH_BYTES, in_arrow, table

#: Payloads are padded with this byte to a positive multiple of FRAME bytes.
PAD, FRAME = 255, 576
SAMPLE_RATE = 8000
WAV_HEADER = 44

# Validators: (blob, start) -> length of a sound object that starts there, or 0.


def _wav(b: bytes, at: int) -> int:
    """RIFF: the size must cover a fmt and a data chunk, and chunks must fill it exactly."""
    if b[at + 8 : at + 12] != b"WAVE" or at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, pos)
        seen.add(name)
        pos += 8 + size + (size & 1)
    return end - at if {b"fmt ", b"data"} <= seen and pos in (end, end + 1) else 0


def _png(b: bytes, at: int) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or (first and name != b"IHDR"):
            return 0
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return 0
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int) -> int:
    """Screen descriptor, then blocks up to the trailer."""
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return 0


@lru_cache(4)
def _places(b: bytes, mark: bytes) -> list[int]:
    """All places of a mark that cannot overlap itself, so a blob is searched once, however many magics ask for it."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


def _next(b: bytes, mark: bytes, at: int) -> int:
    """The first place of a mark from `at` on, -1 if there is none."""
    found = _places(b, mark)
    i = bisect_left(found, at)
    return found[i] if i < len(found) else -1


def _jpeg(b: bytes, at: int) -> int:
    """Marker segments with lengths up to the scan, then entropy-coded data up to the end marker."""
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF or not 0xC0 <= b[pos + 1] <= 0xFE:
            return 0
        kind, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        pos += 2 + size
        if kind == 0xDA:
            end = _next(b, b"\xff\xd9", pos)
            return end + 2 - at if end >= 0 else 0
    return 0


def _pdf(b: bytes, at: int) -> int:
    """Version, then the first end-of-file mark after a startxref."""
    if not b[at + 5 : at + 6].isdigit():
        return 0
    xref = _next(b, b"startxref", at)
    end = _next(b, b"%%EOF", xref) if xref >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def _zip(b: bytes, at: int) -> int:
    """A local header whose archive ends in a central directory that points back to it."""
    end = _next(b, b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + offset + size == end and end + 22 + note <= len(b) else 0


FORMATS: dict[str, tuple[tuple[bytes, ...], Callable[[bytes, int], int]]] = {
    "audio/wav": ((b"RIFF",), _wav),
    "image/png": ((b"\x89PNG\r\n\x1a\n",), _png),
    "image/gif": ((b"GIF87a", b"GIF89a"), _gif),
    "image/jpeg": ((b"\xff\xd8\xff",), _jpeg),
    "application/pdf": ((b"%PDF-",), _pdf),
    "application/zip": ((b"PK\x03\x04",), _zip),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (magics, _) in FORMATS.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(blob: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, length) of the sound objects in a blob, by start; those inside another are left out.

    An object that starts where another one has already begun is part of it.
    """
    found, free = [], 0
    for last, (kind, size) in machine.iter(blob.decode("latin-1")):
        start = last + 1 - size
        if start >= free and (length := FORMATS[kind][1](blob, start)):
            found.append((kind, start, length))
            free = start + length
    return found


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM: every byte of the payload is a sample, so nothing is lost."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(media: bytes) -> bytes:
    """The data chunk, found by walking the chunks."""
    pos = 12
    while pos + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, pos)
        if name == b"data":
            return media[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def features(samples: bytes) -> str:
    """Integers only, so equal samples give equal features: count, peaks, mean, energy, crossings."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    total, energy = int(counts @ level), int(counts @ (level - 128) ** 2)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    used = np.flatnonzero(counts)
    return f"wav;n={len(x)};min={used[0]};max={used[-1]};mean_milli={total * 1000 // len(x)};energy_milli={energy * 1000 // len(x)};crossings={crossings};levels={len(used)}"


_FOUND = ["declared_type", "true_type", "carved_type", "start", "length", "media"]

Batches = Iterator[pa.RecordBatch]


def carver(kept: pa.Schema) -> Callable[[Batches], Batches]:
    """A function of batches (kept columns, declared type, blob) that gives kept columns and those in _FOUND.

    Rows go on as soon as their media reach a few megabytes, so what a task holds does not depend on how many there are.
    """
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema([*kept, *zip(_FOUND, types, strict=True)])
    n = len(kept)

    def carve(batches: Batches) -> Batches:
        machine = automaton()
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                said, data = batch.column(n)[i].as_py(), batch.column(n + 1)[i].as_py() or b""
                found = sniff(data, machine)
                true = next((k for k, start, _ in found if start == 0), said)
                own = [c[i].as_py() for c in batch.columns[:n]]
                for kind, start, length in found or [(None, None, 0)]:
                    media = None if kind is None else data[start : start + length]
                    rows.append((*own, said, true, kind, start, None if kind is None else length, media))
                    held += length
                if held > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return carve


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def sniff_column(df: DataFrame, blob: str, declared: str, keep: list[str]) -> DataFrame:
    """One row per object carved from the column blob, or one with nulls where there is none.

    Columns: those in keep, declared_type, true_type (of the whole blob: the type that starts at 0, else the declared one), carved_type, start,
    length, media; a column in keep of one of these names gives way to it. A null blob counts as empty. The objects of a blob are in one row each; a blob is
    one value and is walked whole, however long it is. Rows that repeat are sniffed each, an empty table gives no rows.
    """
    keep = [c for c in keep if c not in _FOUND]
    chosen = df.select(*keep, F.col(declared).alias("declared_type"), F.col(blob).cast("binary").alias("blob"))
    kept = chosen.select(*keep)
    more = "declared_type string, true_type string, carved_type string, start long, length long, media binary"
    schema = StructType([*kept.schema, *StructType.fromDDL(more)])
    return in_arrow(chosen, carver(to_arrow_schema(kept.schema)), schema)


#: What the stored blobs are wrapped in, so that the media has to be found and carved.
WRAP_HEAD, WRAP_TAIL = b"\0\0wrapped\0", b"\0end"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared_type", pa.string()), ("blob", pa.binary())])


def _wrap(batches: Batches) -> Batches:
    for batch in batches:
        rows, held = [], 0
        for i in range(batch.num_rows):
            t = (batch.column(1)[i].as_py() or "").encode()
            blob = WRAP_HEAD + to_wav(t + bytes([PAD]) * (-len(t) % FRAME or FRAME * (not t))) + WRAP_TAIL
            rows.append((batch.column(0)[i].as_py(), len(t), "application/octet-stream", blob))
            held += len(blob)
            if held > BATCH_BYTES:
                yield _batch(rows, _STORED)
                rows, held = [], 0
        yield _batch(rows, _STORED)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared_type and blob: the text as samples of a WAV file inside a wrapper.

    Null texts count as empty; an empty text gives one frame of padding. Other columns are ignored;
    repeated rows are stored once each, null ids are kept.
    """
    return in_arrow(docs.select("doc_id", "text"), _wrap, "doc_id long, n_bytes long, declared_type string, blob binary")


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DESCRIBED_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in _DESCRIBED.split(", "))])


def _describe(batches: Batches) -> Batches:
    """doc_id, n_bytes and what the samples of the WAV file (the last column) say."""
    for batch in batches:
        rows = []
        for doc_id, n_bytes, m in zip(batch.column(0), batch.column(1), batch.column(batch.num_columns - 1), strict=True):
            m = m.as_py()
            p = wav_samples(m)
            rows.append((doc_id.as_py(), n_bytes.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(p)))
        yield _batch(rows, _DESCRIBED_ARROW)


def describe_media(carved: DataFrame) -> DataFrame:
    """Reads the samples of each carved WAV file back and describes them; null ids and rows that repeat stay, an empty table gives no rows."""
    return in_arrow(carved.select("doc_id", "n_bytes", "media"), _describe, _DESCRIBED)


def stored_and_described(docs: DataFrame) -> DataFrame:
    """store_texts, sniff_column and describe_media one after the other in one Python worker; blobs never leave it."""
    kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64())])
    carve = carver(kept)

    def sounds(batches: Batches) -> Batches:
        for batch in carve(_wrap(batches)):
            mine = pc.and_(pc.equal(batch.column("carved_type"), "audio/wav"), pc.equal(batch.column("start"), len(WRAP_HEAD)))
            yield batch.filter(mine)

    return in_arrow(docs.select("doc_id", "text"), lambda batches: _describe(sounds(batches)), _DESCRIBED)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_and_described(table(spark, sf_dir, "documents"))
