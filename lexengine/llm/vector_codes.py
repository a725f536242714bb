"""Codes of vectors by product quantisation in whole numbers, with annular norm pruning.

Vectors are cut into parts, each part position has a codebook, and a part's code is the number of its nearest entry.
Codebooks start as the parts of the first vectors and move to the means of what they hold, a few rounds.

The nearest entry is found by norms: an entry whose norm differs from the part's by more than the best distance so far
cannot be nearer. Entries are sorted by norm, the interval that the best distance allows is searched by
bisection, and the entries in that annulus, both ends included, are compared exactly, from the part's own norm outward, while the interval shrinks.

Sums are summed by Spark in limbs of 30 bits, so they are exact whatever the number of vectors. Only codebooks come to the
driver; their size depends on the vectors' length alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import in_arrow, join_hot, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that are compared on either side of a part's norm before the interval is searched again; parts that are compared together.
STEP, TOGETHER = 8, 4096
_LIMB = 30
_MOST = (1 << 63) - 1


def _fits(width: int, *arrays: np.ndarray) -> bool:
    """Whether all squared distances of parts of this width fit 64 bits."""
    return all(a.dtype != object for a in arrays) and width * (2 * max([1, *(int(np.abs(a).max(initial=0)) for a in arrays)])) ** 2 <= _MOST


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest entry of book to each row of x; of equally near ones the first.

    Numbers too large for 64 bits are compared with all entries, in Python's whole numbers.
    """
    if _fits(x.shape[1], x, book):
        norm = np.sqrt((book**2).sum(1).astype(float))
        order = np.lexsort((np.arange(len(book)), norm))
        search = lambda own: _annular(own, book[order], norm[order], order)
    else:
        x, book = x.astype(object), book.astype(object)
        search = lambda own: _all(own, book)
    parts = [search(x[at : at + TOGETHER]) for at in range(0, len(x), TOGETHER)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2


def _all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    code = np.array([min(range(len(book)), key=row.__getitem__) for row in distance], np.int64)
    return code, distance[np.arange(len(x)), code]


def _annular(x: np.ndarray, book: np.ndarray, norm: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() for entries sorted by norm; number says which entry each was."""
    n, size = len(x), len(book)
    own = np.sqrt((x**2).sum(1).astype(float))
    best, code = np.full(n, _MOST), np.full(n, size)
    # Entries from low to high were compared; those from first to last have to be.
    low = np.searchsorted(norm, own)
    high, first, last = low.copy(), np.zeros(n, int), np.full(n, size)
    todo = np.arange(n)
    ahead = np.arange(STEP)
    while len(todo):
        at = np.c_[low[todo, None] - 1 - ahead, high[todo, None] + ahead]
        asked = np.c_[at[:, :STEP] >= first[todo, None], at[:, STEP:] < last[todo, None]]
        row, column = np.nonzero(asked)
        entry = at[row, column]
        distance = np.full(at.shape, _MOST)
        distance[row, column] = ((x[todo[row]] - book[entry]) ** 2).sum(1)
        found = distance.min(1)
        numbers = np.full(at.shape, size)
        numbers[row, column] = number[entry]
        numbers = np.where(distance == found[:, None], numbers, size).min(1)
        better = (found < best[todo]) | ((found == best[todo]) & (numbers < code[todo]))
        best[todo[better]], code[todo[better]] = found[better], numbers[better]
        low[todo], high[todo] = np.maximum(low[todo] - STEP, first[todo]), np.minimum(high[todo] + STEP, last[todo])
        # Norms are rounded, so the annulus is wider by more than that.
        reach = np.sqrt(best[todo].astype(float))
        reach += 1e-9 * (own[todo] + reach) + 1e-9
        first[todo], last[todo] = np.searchsorted(norm, own[todo] - reach), np.searchsorted(norm, own[todo] + reach, side="right")
        todo = todo[(low[todo] > first[todo]) | (high[todo] < last[todo])]
    return code, best


def whole_numbers(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """floor(SCALE * x) of the vectors whose components follow each other in values, with zeros up to width."""
    out = np.zeros((len(sizes), width), np.int64)
    inside = np.arange(width) < sizes[:, None]
    if np.abs(values).max(initial=0) < 2.0**50:
        out[inside] = np.floor(SCALE * values).astype(np.int64)
    else:
        out = out.astype(object)
        # Such large doubles are whole numbers themselves.
        out[inside] = [math.floor(SCALE * v) if abs(v) < 2.0**50 else SCALE * int(v) for v in values.tolist()]
    return out


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return whole_numbers(column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()), width)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of rows without null or non-finite components, as a written table."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return stored(vectors.filter(good).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")))


def _limbs(sums: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, limb, value) of each sum that is not 0; limbs have the sum's sign."""
    for place in np.flatnonzero(sums != 0).tolist():
        rest, limb = abs(total := int(sums[place])), 0
        while rest:
            yield place, limb, (rest & ((1 << _LIMB) - 1)) * (1 if total > 0 else -1)
            rest, limb = rest >> _LIMB, limb + 1


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after each part was assigned and each entry became the mean, rounded down, of its parts."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        # A count stands behind the components of each entry.
        sums = np.zeros((parts, entries, width + 1), object)
        for batch in batches:
            x = _rows(batch, parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code, _ = nearest(own, books[p])
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                if len(at):
                    # Sums of a batch's parts that fit the distances fit 64 bits too.
                    own = own if _fits(width * len(own), own) else own.astype(object)
                    sums[p, code[order][at], :width] += np.add.reduceat(own[order], at).astype(object)
                    sums[p, code[order][at], width] += np.diff(np.r_[at, len(order)]).astype(object)
        found = list(_limbs(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["place", "limb", "value"])

    added = in_arrow(vectors.select("vector"), rows, "place long, limb long, value long").groupBy("place", "limb").agg(F.sum("value").alias("value")).toArrow()
    shared.destroy()
    sums = np.zeros(parts * entries * (width + 1), object)
    for place, limb, value in zip(*(added[c].to_pylist() for c in ("place", "limb", "value")), strict=True):
        sums[place] += value << _LIMB * limb
    sums = sums.reshape(parts, entries, width + 1)
    after = books.astype(object)
    used = sums[:, :, width] > 0
    after[used] = sums[used][:, :width] // sums[used][:, width:]
    return _narrow(after)


def _narrow(books: np.ndarray) -> np.ndarray:
    return books.astype(np.int64) if all(abs(v) < 1 << 62 for v in books.ravel()) else books


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of usable vectors; see encode for odd ones."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).toArrow()["vector"].to_pylist()
    start = whole_numbers(np.array([v for row in first for v in row], float), np.array([len(row) for row in first], int), parts * width)
    books = np.stack([start[:, p * width : (p + 1) * width] for p in range(parts)])
    for _ in range(rounds if len(first) else 0):
        books = moved(vectors, books)
    return books


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each usable vector; an error beyond 64 bits is null."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, parts * width)
            near = [nearest(x[:, p * width : (p + 1) * width], shared.value[p]) for p in range(parts)]
            codes = ["".join(f"{c:02x}" for c in row) for row in zip(*(code.tolist() for code, _ in near), strict=True)]
            errors = [e if (e := sum(row)) <= _MOST else None for row in zip(*(far.tolist() for _, far in near), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return in_arrow(vectors.select("vec_id", "label", "vector"), rows, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each usable row of vectors (vec_id, embedding, label).

    Rows with a null vector, or with null or non-finite components, are dropped; other columns are ignored. Rows that repeat are coded
    each and count each. A null vec_id comes after all others, equal ones in order of their components. Shorter vectors count as
    filled with zeros, up to the next multiple of PARTS of the longest. Fewer than ENTRIES rows give as many entries. A null label is a label of its own.
    Errors and their sums that exceed 64 bits are null. An empty table gives no rows.
    """
    vectors = usable(vectors)
    books = fit(vectors)
    # Null labels are equal to each other and to no text.
    key = F.when(F.col("label").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = stored(assign(vectors, books).withColumn("key", key))
    total = F.expr("CASE WHEN count(*) = count(error) THEN try_cast(sum(cast(error AS decimal(38,0))) AS bigint) END")
    sums = coded.groupBy("key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows"))
    found = join_hot(coded, sums, "key", "rows", coded.count())
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings")).drop("label")


def _round_sql(k: int) -> str:
    """near{k}: the nearest entry of book{k} to each part, as distance * ENTRIES + entry; book{k + 1}: the means, rounded down."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT rn, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + e) AS m
  FROM cut JOIN book{k} USING (p) GROUP BY rn, p),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(g.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT p, m % {ENTRIES} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k} JOIN cut USING (rn, p), range(1, 1 + (SELECT max(len(x)) FROM cut)) r(i) GROUP BY p, m % {ENTRIES}, i) GROUP BY p, e) g USING (p, e)),"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT rn, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range(0, {PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS c FROM cut WHERE rn <= {ENTRIES}),{"".join(map(_round_sql, range(ROUNDS)))}
near AS MATERIALIZED (
  SELECT rn, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + e) AS m
  FROM cut JOIN book{ROUNDS} USING (p) GROUP BY rn, p),
coded AS (SELECT rn, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM near GROUP BY rn),
printed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rn), printed
"""
