"""Chains of parents of any length (U6): roots, depths, paths and all ancestors, by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexengine.session import scratch_dir

#: Nodes of trees that a task takes whole; nodes for each task; nodes of paths that are laid out together.
TREE, TASK_ROWS, ENTRIES = 1000, 100_000, 1_000_000


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def chains(nodes: DataFrame, node: str = "id", parent: str = "parent_id", paths: bool = True) -> DataFrame:
    """(node, root, depth, cyclic and, with paths, path from the root down to the node) of every row of nodes.

    Each round lets every node look twice as far as before, so rounds grow with the logarithm of the longest chain; nodes that have
    reached their root leave. When a round passes in which none does, only chains that end in a cycle are left: those nodes are
    cyclic and have no root, depth or path. A parent that is null or no node ends a chain. Nodes are different; null ones are left out, and of
    repeated ones the smallest parent counts. Each round is a written table.
    """
    own = _stored(nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(parent).alias("next")))
    # at is the farthest ancestor that is known to be a node, steps how far it is, next its parent, which may be none; a root is its own.
    zero = F.lit(0).cast("long")
    state = own.select("id", F.lit(None).cast(own.schema["id"].dataType).alias("up"), F.col("id").alias("at"), zero.alias("steps"), "next")
    done = [state.filter("next IS NULL")]
    open_ = state.filter("next IS NOT NULL")
    total, left = own.count(), open_.count()
    for _ in range(total.bit_length() + 2):
        if not left:
            break
        target = reduce(DataFrame.unionByName, [*done, open_])
        target = target.select(F.col("id").alias("next"), F.col("at").alias("to"), F.col("steps").alias("far"), F.col("next").alias("then"))
        moved = open_.join(target, "next", "left").select(
            "id",
            # In the first round the farthest ancestor is the parent.
            F.coalesce("up", "to").alias("up"),
            F.coalesce("to", "at").alias("at"),
            (F.col("steps") + F.coalesce(F.col("far") + 1, zero)).alias("steps"),
            F.col("then").alias("next"),
        )
        moved = _stored(moved)
        done.append(moved.filter("next IS NULL"))
        open_ = moved.filter("next IS NOT NULL")
        before, left = left, open_.count()
        # Below a long chain there is one of every length, so a round in which none ends leaves cycles alone.
        if left == before:
            break
    ended = reduce(DataFrame.unionByName, done).select("id", "up", F.col("at").alias("root"), F.col("steps").alias("depth"), F.lit(False).alias("cyclic"))
    kinds = {c.name: c.dataType for c in ended.schema}
    loops = open_.select("id", F.lit(None).cast(kinds["root"]).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    if not paths:
        return ended.drop("up").unionByName(loops).withColumnRenamed("id", "node")
    found = _with_paths(ended, total)
    return found.unionByName(loops.withColumn("path", F.lit(None).cast(found.schema["path"].dataType))).withColumnRenamed("id", "node")


def _with_paths(ended: DataFrame, total: int) -> DataFrame:
    """(id, root, depth, cyclic, path) of the nodes (id, up, root, depth, cyclic).

    Trees of up to TREE nodes come whole into a task, which walks up from each node; larger ones are left to rounds.
    """
    large = _stored(ended.groupBy("root").count().filter(F.col("count") > TREE).select("root"))
    # At most one in TREE nodes is the root of such a tree.
    some = not large.isEmpty()
    small = ended.join(F.broadcast(large), "root", "left_anti") if some else ended
    parts = max(ended.sparkSession.sparkContext.defaultParallelism, total // TASK_ROWS)
    dealt = small.select("id", "up", "root", "depth", "cyclic").repartition(parts, "root").sortWithinPartitions("root")
    kinds = [*(c for c in ended.schema if c.name != "up"), StructField("path", ArrayType(ended.schema["id"].dataType))]
    found = dealt.mapInArrow(_walked, StructType(kinds))
    if not some:
        return found
    rest = ended.join(F.broadcast(large), "root", "left_semi")
    return found.unionByName(rest.drop("up").join(_paths(rest, total.bit_length() + 1), "id"))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root, with the path of each."""
    for tree in _trees(batches):
        ids, depth = tree.column("id").combine_chunks(), tree.column("depth").to_numpy()
        up = pc.fill_null(pc.index_in(tree.column("up"), value_set=ids), -1).to_numpy()
        ends = np.cumsum(depth + 1)
        # Paths are made for so many rows at once as have about ENTRIES nodes in all.
        cut = np.searchsorted(ends, np.arange(ENTRIES, ends[-1] + ENTRIES, ENTRIES), "right")
        cut = np.unique(np.r_[0, cut, len(ends)])
        for begin, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            offsets = np.r_[0, np.cumsum(depth[begin:end] + 1)]
            path, at, place = np.empty(offsets[-1], np.int64), np.arange(begin, end), offsets[1:] - 1
            while len(at):
                path[place] = at
                at, place = up[at], place - 1
                at, place = at[at >= 0], place[at >= 0]
            part = tree.slice(begin, end - begin).drop_columns("up")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(path)))
            yield from part.append_column("path", lists).combine_chunks().to_batches()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by root, cut so that those of one root stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        roots = batch.column("root")
        cut = pc.index(roots, roots[-1]).as_py()
        if cut or (held and held[-1].column("root")[-1] != roots[0]):
            if before := [*held, *([batch.slice(0, cut)] if cut else [])]:
                yield pa.Table.from_batches(before)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _paths(linked: DataFrame, rounds: int) -> DataFrame:
    """(id, path) of nodes (id, up) without cycles: paths of doubling length are put together until each begins at a root."""
    path = _stored(linked.select("id", F.col("up").alias("at"), F.array("id").alias("path")))
    for _ in range(rounds):
        if path.filter("at IS NOT NULL").isEmpty():
            break
        above = path.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("path").alias("before"))
        joined = path.filter("at IS NOT NULL").join(above, "at").select("id", F.col("next").alias("at"), F.concat("before", "path").alias("path"))
        path = _stored(path.filter("at IS NULL").unionByName(joined))
    return path.select("id", "path")


def ancestors(found: DataFrame) -> DataFrame:
    """(node, ancestor, distance) from what chains() gave with paths: each node with every node above it."""
    return found.filter("NOT cyclic").select("node", F.posexplode("path").alias("place", "ancestor"), "depth").filter(F.col("place") < F.col("depth")).select("node", "ancestor", (F.col("depth") - F.col("place")).alias("distance"))
