"""Joins by time: the last row before (as-of), and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one range of time, on average, and ranges at most.
RANGE_ROWS, RANGES = 1_000_000, 4096
#: Intervals of one side that meet the other side's in one task.
CELL_ROWS = 10_000


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, keep: list[str], strict: bool = False, ranges: int | None = None) -> DataFrame:
    """Each row of left with the columns in keep of the last row of right with the same key at the same time or before (strict: before).

    Both sides have key and time. Time is cut into ranges by its own distribution, so the rows of one key spread over all ranges. Inside a range a
    running last is taken; the last right row of each key and range is carried to the later ranges by a running last over ranges, of
    which there are few. Of right rows at one time the one with the greatest values in keep counts. Left rows without a key or time, and
    those with nothing before them, get nulls; right rows without are left out. Columns in keep that left has too give way to right's.
    """
    number = (lambda c: c.cast("timestamp").cast("double")) if dict(right.dtypes)[time].startswith(("timestamp", "date")) else lambda c: c
    if ranges is None:
        ranges = max(1, min(RANGES, -(-right.count() // RANGE_ROWS)))
    # One row with fewer numbers than RANGES.
    cuts = right.select(F.percentile_approx(number(F.col(time)), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < number(F.col("t")))) if cuts else F.lit(0)
    own = [c for c in left.columns if c not in keep]
    a = left.select(F.struct(*own).alias("row"), F.col(key).alias("k"), F.col(time).alias("t"), F.lit(None).alias("found"))
    b = right.select(F.lit(None).alias("row"), F.col(key).alias("k"), F.col(time).alias("t"), F.struct(F.col(time).alias("t"), *keep).alias("found")).filter("k IS NOT NULL AND t IS NOT NULL")
    none = a.filter("k IS NULL OR t IS NULL")
    a = a.filter("k IS NOT NULL AND t IS NOT NULL")
    both = a.withColumn("found", F.lit(None).cast(b.schema["found"].dataType)).unionByName(b.withColumn("row", F.lit(None).cast(a.schema["row"].dataType)))
    both = both.withColumn("part", part)
    # At one time right rows come first, or last if they have to be before.
    side = F.col("found").isNull()
    inside = Window.partitionBy("k", "part").orderBy("t", ~side if strict else side, "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.last("found", ignorenulls=True).over(inside)).filter("row IS NOT NULL")
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("k", "part").agg(F.max("found").alias("last")).select("k", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    found = near.join(carried, ["k", "part"]).select("row", F.coalesce("near", "carried").alias("found"))
    missing = none.select("row", F.lit(None).cast(b.schema["found"].dataType).alias("found"))
    return found.unionByName(missing).select("row.*", *[F.col("found")[c].alias(c) for c in keep])


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str, end: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(l, r): pairs of rows (as structs) of the same key whose intervals, whole numbers with both ends included, have a point in common; each pair once.

    An interval belongs to the level of the smallest power of two that is as wide, and lies in two cells of that width at most. It
    stands in its cells of its own level and of all wider levels that the other side has for its key, so it is copied twice per level, whatever its length. A pair
    meets at the wider of its levels, in the cell where the later of them begins. Cells with more than cell_rows rows of the left side are
    dealt to blocks that meet the cell's right rows in tasks of their own. Intervals without a key, start or end, or that end before they start, meet nothing.
    """
    def placed(df: DataFrame) -> DataFrame:
        found = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).filter("k IS NOT NULL AND a <= b")
        # Digits of (width - 1) in base 2.
        return found.withColumn("own", F.length(F.bin(F.col("b") - F.col("a"))).cast("int")).withColumn("own", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("own")))

    def celled(df: DataFrame, levels: DataFrame) -> DataFrame:
        known = df.join(levels, "k").select("*", F.explode(F.filter(F.array_union("levels", F.array("own")), lambda x: x >= F.col("own"))).alias("level"))
        # Shifts of negative numbers go down, like floor.
        low, high = F.expr("shiftright(a, level)"), F.expr("shiftright(b, level)")
        return known.withColumn("cell", F.explode(F.sequence(low, high))).drop("levels")

    def levels_of(df: DataFrame) -> DataFrame:
        return df.groupBy("k").agg(F.sort_array(F.collect_set("own")).alias("levels"))

    a, b = placed(left), placed(right)
    x, y = celled(a, levels_of(b)), celled(b, levels_of(a))
    at = ["k", "level", "cell"]
    blocks = x.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("blocks")).filter("blocks > 1")
    x = x.join(blocks, at, "left").withColumn("block", F.pmod(F.xxhash64("a", "b", "row"), F.coalesce("blocks", F.lit(1)))).drop("blocks")
    y = y.join(blocks, at, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    pairs = x.alias("x").join(y.alias("y"), [*at, "block"])
    once = (F.greatest("x.own", "y.own") == F.col("level")) & (F.expr("shiftright(greatest(x.a, y.a), level)") == F.col("cell"))
    return pairs.filter(once & (F.col("x.a") <= F.col("y.b")) & (F.col("y.a") <= F.col("x.b"))).select(F.col("x.row").alias("l"), F.col("y.row").alias("r"))
