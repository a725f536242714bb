"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a random key from a hash. Within each source the documents are sorted by that
key, range by range: the keys are uniform, so cutting the key space into equal ranges gives ranges of
equal size, and a large source simply has more of them. Sums of the ranges give each range its
offset, a running sum inside a range gives each document its place, and the source is cut where its
budget ends, after as many whole passes (epochs) as the budget holds.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexengine.llm.common import WORD, stored, table

WEIGHTS = (3, 1, 2)
#: The size of the mix is this share of all sizes, and a source is taken at most MAX_EPOCHS times.
SHARE_NUM, SHARE_DEN, MAX_EPOCHS = 3, 2, 2
#: Documents in one range of keys, on average.
RANGE_ROWS = 5_000
#: Keys have 60 bits: the first 15 hexadecimal digits of an MD5 digest.
KEY_BITS = 60
_WORD = re.compile(WORD)


def words(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its word number n."""
    end = 0
    for found in islice(_WORD.finditer(text), n):
        end = found.end()
    return text[:end]


def random_key(doc_id: Column, seed: int) -> Column:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds target to one row per source (source, source_size, docs).

    Weights repeat over the sources by code point, null last. Sources whose share is above
    MAX_EPOCHS times their size get just that, and the excess goes to the others by weight, until
    none is above. That is reached by filling sources in order of size / weight: the capped ones
    are a prefix of that order. The table has one row per source, so one task sorts it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (pick + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # All in units of 1 / SHARE_DEN words, so that only the last division leaves the integers.
    cap = F.col("source_size") * (MAX_EPOCHS * SHARE_DEN)
    left = F.sum("source_size").over(everything) * SHARE_NUM - F.coalesce(F.sum(cap).over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumns({"cap": cap, "left": left, "heavy": heavy})
    ranked = ranked.withColumn("capped", F.col("cap") * F.col("heavy") <= F.col("weight") * F.col("left"))
    # The first source below its cap ends the prefix; it and all after it share what is left there.
    open_ = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")), "left", "heavy"))).over(everything)
    target = F.when(F.col("capped"), (F.col("source_size") * MAX_EPOCHS).cast("double")).otherwise(
        (F.col("weight") * open_["left"]).cast("double") / (open_["heavy"] * SHARE_DEN).cast("double")
    )
    return ranked.select("source", "source_size", "docs", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, range_rows: int = RANGE_ROWS, extra: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, key, source_size, target, taken, and the columns in extra.

    docs needs doc_id, text and source; other columns are ignored. Documents without words, and
    with them null and empty texts, have size 0 and are taken 0 times. A null source is a source
    of its own and comes last. The words taken from a source are its target, rounded; the document at the cut is
    taken in part. Columns in extra that are named like one of the mix give way. Rows with equal keys are ordered by doc_id, size and extra, so that reruns agree. An empty table gives
    no rows.
    """
    extra = [c for c in extra if c not in ("doc_id", "source", "size", "key", "source_size", "target", "taken")]
    # Extra columns travel as one, so that no name of theirs meets one of the mix.
    own = F.struct(*extra) if extra else F.lit(None).cast("int")
    slim = docs.select(own.alias("extra"), "doc_id", "source", words(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    slim = stored(slim)
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = stored(targets(sources, weights).withColumn("ranges", F.ceil(F.col("docs") / range_rows)))
    # One row per source; sources are labels, so they are few, but the join may also shuffle.
    wide = slim.join(sources, slim.source.eqNullSafe(sources.source)).select(
        "extra", "doc_id", slim.source, "size", "key", "source_size", "target", F.least(F.floor(F.col("key") / F.lit(2.0**KEY_BITS) * F.col("ranges")), F.col("ranges") - 1).alias("range")
    )
    sums = wide.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "extra").rowsBetween(Window.unboundedPreceding, -1)
    placed = wide.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, placed.source.eqNullSafe(sums.s) & (placed.range == sums.r))
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = budget - passes * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("range_start") - F.col("before"), F.lit(0).cast("long")), F.col("size"))
    return placed.select(*[F.col("extra")[c].alias(c) for c in extra], "doc_id", "source", "size", "key", "source_size", "target", (passes * F.col("size") + part).alias("taken"))


def ends(mixed: DataFrame, place: list[str]) -> DataFrame:
    """One row per source (source, passes, last) that says where the mix ends.

    All rows of a source are taken `passes` times, and once more up to the row last.at, of which last.more words
    are taken. place are the columns in extra, by which the rows of `mixed` are told apart. A null source has a row of its own; a source
    without words has passes 0 and no last; an empty table gives no rows.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    again = mixed.withColumn("passes", passes).withColumn("more", F.col("taken") - F.col("passes") * F.col("size"))
    at = F.struct("key", "doc_id", "size", *place)
    return again.groupBy("source").agg(F.max("passes").alias("passes"), F.max(F.when(F.col("more") > 0, F.struct(at.alias("at"), "more"))).alias("last"))


def taken_up_to(docs: DataFrame, until: DataFrame, place: list[str], seed: int = 0) -> DataFrame:
    """docs with size and taken, by where the mix of their source ends; so whole texts need no shuffle.

    Columns of docs that are named size or taken give way. Null and empty texts have size 0 and are taken 0 times, null sources meet
    theirs, rows that repeat are told apart by place, and an empty table gives no rows.
    """
    named = docs.select(*[F.col(c).alias(f"place_{i}") for i, c in enumerate(place)], F.struct("*").alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    end = until.select(F.col("source").alias("of"), "passes", "last")
    found = named.join(end, F.col("source").eqNullSafe(F.col("of")))
    at = F.struct("key", "doc_id", "size", *[F.col(f"place_{i}").alias(c) for i, c in enumerate(place)])
    more = F.when(at < F.col("last.at"), F.col("size")).when(at == F.col("last.at"), F.col("last.more")).otherwise(F.lit(0).cast("long"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "taken")]
    return found.select(*own, "size", (F.col("passes") * F.col("size") + more).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "key")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM s
), f AS (
  SELECT *, 4 * ss AS cap,
         3 * sum(ss) OVER () - coalesce(sum(4 * ss) OVER (ORDER BY ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy
  FROM w
), o AS (
  SELECT rest, heavy FROM f WHERE cap * heavy > w * rest ORDER BY ss / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT f.source, f.ss,
         CASE WHEN f.cap * f.heavy <= f.w * f.rest THEN CAST(2 * f.ss AS DOUBLE)
              ELSE CAST(f.w * (SELECT rest FROM o) AS DOUBLE) / CAST(2 * (SELECT heavy FROM o) AS DOUBLE) END AS target
  FROM f
), p AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.ss AS source_size, t.target,
         CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM p
"""
