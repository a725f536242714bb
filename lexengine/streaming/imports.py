"""Import of records as a stream: the tables of a bulk import, whatever the batches and however often one is run again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seen keys are held on disk, without expiry.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def start_import(rows: DataFrame, known: DataFrame, key: list[str], problem: Column, folder: str) -> StreamingQuery:
    """Starts the import of a stream of rows into folder; what is there when it ends is told by imported().

    Rows for which problem is a text are rejected with it. Of the others those whose key is new come in: of rows that repeat a key the
    first that comes, and none whose key is in known, a table that does not change meanwhile. Rows without a part of the key are rejected; rejected rows that are equal in all columns count once.
    Keys that came in are kept as state, so nothing comes in twice in one run or after a restart; a batch that is run again
    replaces its own files.
    """
    spark = rows.sparkSession
    for name, value in STATE.items():
        spark.conf.set(name, value)
    missing = F.when(F.exists(F.array(*[F.col(k).isNull() for k in key]), lambda x: x), F.lit("no key"))
    checked = rows.withColumn("problem", F.coalesce(missing, problem))
    # Rejected rows are told apart by all they hold, so each comes once; valid rows by their key alone.
    own = F.when(F.col("problem").isNotNull(), F.to_json(F.struct(*rows.columns))).otherwise("")
    once = checked.withColumn("own", own).dropDuplicates([*key, "own"]).drop("own")

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.filter("problem IS NULL").drop("problem").join(known.select(*key), key, "left_anti")
        fresh.select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.filter("problem IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def imported(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows that came in, and those that were rejected with their problem; both empty before the first batch."""
    found = []
    for name, columns in (("rows", schema), ("rejects", f"{schema}, problem string")):
        try:
            found.append(spark.read.schema(f"{columns}, batch long").parquet(f"{folder}/{name}").drop("batch"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found.append(spark.createDataFrame([], columns))
    return found[0], found[1]
