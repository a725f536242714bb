"""A key table that takes inserts (C28): ranges of sorted keys, small delta files beside them, and compaction as a job.

Rows lie in `path/data/range=R/version=V`, sorted by key; inserts since then in `path/delta/batch=B/range=R`. What is current is told by the
last state in `path/state`, one row of text each, so a reader sees a table as it was before or after an insert, never in between, and a job that failed leaves
files that no state names.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyTable:
    """One state: the first key of each range, each range's version, its batches since then, and the number of the state."""

    path: str
    schema: str
    bounds: tuple[str, ...]
    versions: tuple[int, ...]
    batches: tuple[tuple[int, ...], ...]
    number: int

    def ranges_of(self, prefix: str) -> range:
        """The ranges that may hold keys with a prefix."""
        # No key with the prefix is greater than the prefix and the greatest character, again and again.
        return range(max(0, bisect_right(self.bounds, prefix) - 1), max(1, bisect_left(self.bounds, prefix + "\U0010ffff" * 4)))

    def files(self, ranges: list[int] | range) -> list[str]:
        base = [f"{self.path}/data/range={r}/version={self.versions[r]}" for r in ranges if self.versions[r]]
        return base + [f"{self.path}/delta/batch={b}/range={r}" for r in ranges for b in self.batches[r]]


def _saved(spark: SparkSession, table: KeyTable) -> KeyTable:
    spark.createDataFrame([(json.dumps(asdict(table)),)], "value string").coalesce(1).write.text(f"{table.path}/state/number={table.number}")
    return table


def opened(spark: SparkSession, path: str) -> KeyTable:
    """The last state of the table in path."""
    found = spark.read.text(f"{path}/state").orderBy(F.desc("number")).first()
    said = json.loads(found.value)
    return KeyTable(path, said["schema"], tuple(said["bounds"]), tuple(said["versions"]), tuple(map(tuple, said["batches"])), said["number"])


def _ranges(bounds: tuple[str, ...], key: Column) -> Column:
    below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)
    return F.greatest(below - 1, F.lit(0))


def create(rows: DataFrame, path: str, ranges: int) -> KeyTable:
    """Writes rows (key, id and others) as a new table of about so many ranges. Rows without a key are left out; of rows that share key and id one stays."""
    spark = rows.sparkSession
    last = rows.filter("key IS NOT NULL").dropDuplicates(["key", "id"])
    # Ranges are cut by the distribution of keys; each is one task's rows.
    dealt = last.repartitionByRange(ranges, "key").sortWithinPartitions("key", "id").withColumn("range", F.spark_partition_id())
    dealt.withColumn("version", F.lit(1)).write.partitionBy("range", "version").parquet(f"{path}/data")
    try:
        # One row for each range.
        first = [r.first for r in spark.read.parquet(f"{path}/data").groupBy("range").agg(F.min("key").alias("first")).orderBy("range").collect()]
        there = [r.range for r in spark.read.parquet(f"{path}/data").select("range").distinct().orderBy("range").collect()]
    except AnalysisException:
        first, there = [], []
    if not there:
        return _saved(spark, KeyTable(path, rows.schema.simpleString(), ("",), (0,), ((),), 1))
    # Ranges that got no rows begin where the next one does and hold nothing.
    bounds, versions = [], []
    for r in range(max(there) + 1):
        bounds.append(first[bisect_left(there, r)])
        versions.append(int(r in there))
    return _saved(spark, KeyTable(path, rows.schema.simpleString(), tuple(bounds), tuple(versions), ((),) * len(bounds), 1))


def insert(table: KeyTable, rows: DataFrame) -> KeyTable:
    """The table after an insert: rows go to delta files of their ranges, and no other file is touched. A row whose key and id are there already takes its place."""
    spark, number = rows.sparkSession, table.number + 1
    path = f"{table.path}/delta/batch={number}"
    known = rows.filter("key IS NOT NULL").dropDuplicates(["key", "id"])
    known.withColumn("range", _ranges(table.bounds, F.col("key"))).repartition("range").sortWithinPartitions("range", "key", "id").write.partitionBy("range").parquet(path)
    try:
        touched = {r.range for r in spark.read.parquet(path).select("range").distinct().collect()}
    except AnalysisException:
        touched = set()
    batches = tuple((*b, number) if r in touched else b for r, b in enumerate(table.batches))
    return _saved(spark, replace(table, batches=batches, number=number))


def _read(spark: SparkSession, table: KeyTable, ranges: list[int] | range) -> DataFrame:
    """The rows of some ranges, later batches before earlier ones and before the data."""
    paths = table.files(ranges)
    if not paths:
        return spark.createDataFrame([], table.schema)
    parts = []
    for kind in ("data", "delta"):
        own = [p for p in paths if f"/{kind}/" in p]
        if own:
            rows = spark.read.option("basePath", f"{table.path}/{kind}").parquet(*own)
            parts.append(rows.withColumn("turn", F.col("batch").cast("long") if kind == "delta" else F.lit(0).cast("long")).drop("version" if kind == "data" else "batch"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if len(parts) == 1 and "/delta/" not in paths[0]:
        return rows.drop("turn")
    # Key and id are together in one range, and a range is bounded.
    newest = Window.partitionBy("key", "id").orderBy(F.desc("turn"))
    return rows.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth", "turn")


def lookup(spark: SparkSession, table: KeyTable, prefix: str = "") -> DataFrame:
    """The rows whose key has a prefix; only files of ranges that may hold it are read, and the filter reaches the scan."""
    found = _read(spark, table, table.ranges_of(prefix) if prefix else range(len(table.bounds)))
    return (found.filter(F.col("key").startswith(prefix)) if prefix else found).drop("range")


def compact(spark: SparkSession, table: KeyTable) -> KeyTable:
    """The table with all batches merged in: only ranges that have some are written anew, as their next version."""
    touched = [r for r, b in enumerate(table.batches) if b]
    if not touched:
        return table
    number = table.number + 1
    rows = _read(spark, table, touched).withColumn("version", F.lit(number))
    rows.repartition("range").sortWithinPartitions("range", "key", "id").write.mode("append").partitionBy("range", "version").parquet(f"{table.path}/data")
    versions = tuple(number if r in touched else v for r, v in enumerate(table.versions))
    batches = tuple(() if r in touched else b for r, b in enumerate(table.batches))
    return _saved(spark, replace(table, versions=versions, batches=batches, number=number))
