"""Helpers shared by the training-data operators: tables, scratch space and hot-key joins."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that a Python worker gets at once; a row that is longer comes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Keys that hold more than one part in HOT_PARTS of all rows are hot; so there are at most HOT_PARTS.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python workers in small batches from now on, unless it has a bound of its own.

    Plans run when the caller takes their rows, so the setting cannot end with the function that makes them.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


#: What a Python worker keeps from task to task.
_kept: dict[str, object] = {}

#: Seconds between two times that a task gives back memory.
FREE_SECONDS = 1


def kept(name: str, make: Callable):
    """make(), once in a Python worker for as long as its tasks are of stages that keep something of this name."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget_others(name: str | None) -> None:
    """Drops what stages of other names have kept in this worker."""
    for other in [k for k in _kept if k != name]:
        del _kept[other]
    give_back()


def give_back() -> None:
    """Memory that is free already goes back to the system; else a worker would hold the most that any of its batches took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def _giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = time.monotonic()
    for batch in batches:
        yield batch
        del batch
        if time.monotonic() - last > FREE_SECONDS:
            give_back()
            last = time.monotonic()


def in_arrow(df: DataFrame, rows: Callable, schema, keeps: str | None = None) -> DataFrame:
    """mapInArrow over small batches, in workers that hold nothing kept() but what has the name keeps."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        yield from rows(_giving_back(batches))
        give_back()

    return small_batches(df).mapInArrow(lean, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside the folder that all executors share (spark.checkpoint.dir).

    Only a local session may name none; it gets a temporary folder. On a cluster executors would not see that.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexengine-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lexengine/{uuid.uuid4().hex}"
    for names in _open_scratch:
        names.append(path)
    return path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows as a written table, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


_open_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders of shared_dir() that are named inside a with block are deleted at its end, in whatever store they lie."""
    _open_scratch.append(names := [])
    try:
        yield
    finally:
        _open_scratch.pop()
        for name in names:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside a with block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bloom(spark: SparkSession):
    """Lets joins that run in a with block skip, by a Bloom filter of the small side, rows of the large side without a partner."""
    return settings(
        spark,
        {
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
        },
    )


def blocks(rows: int, per_block: int) -> int:
    """How many blocks of about per_block rows hold all rows."""
    return max(1, -(-rows // per_block))


def join_hot(left: DataFrame, groups: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Inner join of many rows with one row per key, whatever share of the rows a key has.

    groups has one row per key and, in the column size, how many rows of left carry it. Keys with
    more than rows / HOT_PARTS rows are at most HOT_PARTS, and only those are broadcast; rows of
    all other keys meet by a shuffle, in which no key is large.
    """
    bound = rows / HOT_PARTS
    hot = groups.filter(F.col(size) > bound)
    cold = groups.filter(F.col(size) <= bound)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
