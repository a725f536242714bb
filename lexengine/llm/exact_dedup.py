"""Exact deduplication by a stateful stream: keyed state on disk, without expiry.

The stream reads one slim row per document (digest, identifier, content locator) and keeps, per
digest, the identifier and the locator of the row that stays and the number of rows. The state lives
in RocksDB and is checkpointed in the shared folder. On hits, the locators lead back to the full
texts, which are compared byte by byte; rows whose bytes differ from those of the row that stays
(a digest collision) are grouped anew by the bytes themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import bloom, join_hot, settings, shared_dir, stored, table

#: Copies that are compared with one replica of the text that stays.
COPIES_PER_REPLICA = 256

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store takes megabytes of local disk even if it is nearly empty, so each is closed after its task.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filed(docs: DataFrame) -> DataFrame:
    """docs itself, or its rows written and read again if they lie in no file."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs)


def located(docs: DataFrame) -> DataFrame:
    """Adds the column loc (file, row in the file), the same for the same rows of the same files; others are written first."""
    return filed(docs).withColumn("loc", F.struct("_metadata.file_path", "_metadata.row_index"))


def stream_groups(spark: SparkSession, slim_path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Runs the stateful stream over slim rows; the last state of each digest comes back.

    Every micro-batch writes only the digests that it touched, under its batch number, so that a
    batch that is run again after a failure replaces its own output.
    """
    out, checkpoint = shared_dir(spark), shared_dir(spark)
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state = source.parquet(slim_path).groupBy("digest").agg(
        F.max(F.struct("doc_id", "loc")).alias("top"), F.count(F.lit(1)).alias("group_size")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, _STATE):
        stream = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
    rows = spark.read.schema(
        state.schema.add("batch", "long")
    ).parquet(out)
    last = rows.groupBy("digest").agg(F.max_by(F.struct("top", "group_size"), "batch").alias("s"))
    return last.select("digest", F.col("s.top.doc_id").alias("keep_id"), F.col("s.top.loc").alias("keep_loc"), F.col("s.group_size").alias("group_size"))


def dedup(docs: DataFrame, digest=sha256_digest, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and loc.

    docs needs doc_id and text; other columns are ignored. Null texts count as empty, empty texts
    equal each other. A null doc_id is smaller than any other. Of rows that are equal in text and
    doc_id, the last by locator stays, so exactly one row of each group is kept. An empty table
    gives an empty result. digest can be replaced by any function of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = located(docs.select("doc_id", text.alias("text")))
    slim_path = shared_dir(spark)
    slim = stored(docs.select("doc_id", "loc", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256")), slim_path)
    rows = slim.count()
    if not rows:
        return slim.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "loc")
    groups = stored(stream_groups(spark, slim_path, slim.schema, files_per_batch))
    found = join_hot(slim, groups, "digest", "group_size", rows).select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("loc") == F.col("keep_loc")).alias("kept"), "text_sha256", "loc", "keep_loc"
    )
    found = stored(found)
    odd = _differing(docs, found)
    if odd is None:
        return found.drop("digest", "keep_loc")
    return _regrouped(found, odd)


def _differing(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """Rows (loc, digest, text) whose bytes differ from those of the row that stays, if any."""
    hits = found.filter(F.col("group_size") > 1).select("loc", "digest", "keep_loc", "kept", F.ceil(F.col("group_size") / COPIES_PER_REPLICA).alias("replicas"))
    with bloom(docs.sparkSession):
        texts = hits.join(docs.select("loc", "text"), "loc")
        copies = texts.filter(~F.col("kept")).withColumn("salt", F.pmod(F.xxhash64("loc"), F.col("replicas")))
        stay = texts.filter("kept").select(
            F.col("loc").alias("keep_loc"), F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("replicas") - 1)).alias("salt")
        )
        odd = stored(copies.join(stay, ["keep_loc", "salt"]).filter(F.col("text") != F.col("kept_text")).select("loc", "digest", "text"))
    return None if odd.isEmpty() else odd


def _regrouped(found: DataFrame, odd: DataFrame) -> DataFrame:
    """Digest collisions: rows with other bytes leave their group and form groups of their own."""
    ids = found.select("loc", "doc_id", "text_sha256")
    odd = odd.join(ids, "loc")
    anew = odd.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "loc")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    anew = odd.join(anew, ["digest", "text"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("loc") == F.col("top.loc")).alias("kept"), "text_sha256", "loc"
    )
    fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("left"))
    same = found.join(odd.select("loc"), "loc", "left_anti").join(fewer, "digest", "left")
    same = same.withColumn("group_size", F.col("group_size") - F.coalesce("left", F.lit(0)))
    return same.select(anew.columns).unionByName(anew)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("loc")


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
