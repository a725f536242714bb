"""Exact order statistics per group (A19), and mergeable sketches beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexengine.session import scratch_dir

#: Groups of at most so many rows are sorted as they are; bits of a value that a round over the others fixes.
SMALL, BITS = 100_000, 8


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rank_of(n: Column, q: Column) -> Column:
    """The place, from 1, of the discrete quantile q among n values: the smallest value that at least the share q does not exceed."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(n * q - 1e-9))


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float], small: int = SMALL) -> DataFrame:
    """(group, q, n, x): for each group and share q the value x at its place among the group's n values, exactly.

    Groups of up to `small` rows are sorted. Values of larger ones (whole numbers) are counted by their next BITS bits, from the highest
    down, among those that agree with what is known of the wanted value; each round fixes the bits in which its place lies, so a group is summed up
    in counts, 2^BITS of them at most for each share, and never meets in one task. Null values do not count, null groups are one group; groups without values are left out.
    """
    slim = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("long").alias("v"))
    # Groups that are null are equal to each other.
    slim = slim.withColumn("key", F.struct(F.col("g").isNull().alias("none"), "g"))
    sizes = _stored(slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    # Groups can be many, so no list of them is sent to all tasks.
    few = slim.join(sizes.filter(F.col("n") <= small).hint("merge"), "key").select("key", "n", "v")
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("v")).cast("long"))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    found = placed.select("key", F.explode(F.filter(wanted, lambda q: rank_of(F.col("n"), q) == F.col("place"))).alias("q"), "n", F.col("v").alias("x"))
    asked = sizes.select("key", "n", F.explode(wanted).alias("q")).withColumn("place", rank_of(F.col("n"), F.col("q")))
    large = asked.filter(F.col("n") > small)
    if not large.isEmpty():
        found = found.unionByName(_by_bits(slim.select("key", "v"), large))
    return found.select(F.col("key.g").alias(group), "q", "n", "x")


def _by_bits(slim: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, q, n, x) of large groups; the sign bit is turned, so that order by bits is order by value."""
    low, high = slim.agg(F.min("v"), F.max("v")).first()
    # All values agree in the bits above those in which the least and the greatest differ.
    open_bits = -(-((low ^ high) % 2**64).bit_length() // BITS) * BITS
    agreed = (low + 2**63) >> open_bits
    known = _stored(asked.select("key", "q", "n", "place", F.lit(agreed - 2**64 if agreed >= 2**63 else agreed).cast("long").alias("high")))
    bits = F.col("v").bitwiseXOR(F.lit(-(2**63)))
    for shift in range(open_bits - BITS, -1, -BITS):
        # Of a value the bits above shift + BITS have to be those that are known.
        above = F.lit(0).cast("long") if shift + BITS == 64 else F.shiftrightunsigned(bits, shift + BITS)
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND((1 << BITS) - 1)
        agreeing = slim.select("key", above.alias("high"), digit.alias("digit")).join(known.select("key", "high").distinct().hint("merge"), ["key", "high"], "left_semi")
        counts = agreeing.groupBy("key", "high", "digit").agg(F.count(F.lit(1)).alias("m"))
        order = Window.partitionBy("key", "q").orderBy("digit")
        upto = known.hint("merge").join(counts, ["key", "high"]).withColumn("upto", F.sum("m").over(order))
        here = upto.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("m") < F.col("place")))
        known = _stored(here.select("key", "q", "n", (F.col("place") - F.col("upto") + F.col("m")).alias("place"), (F.shiftleft("high", BITS).bitwiseOR(F.col("digit"))).alias("high")))
    return known.select("key", "q", "n", F.col("high").bitwiseXOR(F.lit(-(2**63))).alias("x"))


def sketches(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, sketch): a summary of each group's values; summaries of parts can be merged with kll_merge_agg_bigint."""
    return rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long")).alias("sketch"))


def sketch_quantile(sketch: Column, share: float) -> Column:
    """About the quantile; its rank is off by less than two hundredths of the group's size, nearly always."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(share))
