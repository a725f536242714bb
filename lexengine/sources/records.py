"""Files of nested records: JSON arrays and Parquet snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lexengine.schema import ENTRY


def read_json(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """Files of one record per line, as write_json makes them, or of an array or a record over several lines.

    The first line tells which. A path that is missing is an empty source.
    """
    try:
        first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    line = first[0].value.strip() if first else ""
    return spark.read.schema(schema).json(path, multiLine=not (line.startswith("{") and line.endswith("}")))


def from_request(spark: SparkSession, record: dict, schema: str = ENTRY) -> DataFrame:
    """One nested record as a table of one row; fields that it lacks are null, fields that the schema lacks are an error."""
    known = StructType.fromDDL(schema).names
    if unknown := set(record) - set(known):
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return spark.createDataFrame([tuple(record.get(n) for n in known)], schema)


def write_json(rows: DataFrame, path: str) -> None:
    """One record per line, in as many files as the rows have partitions."""
    rows.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A new snapshot beside the old one; readers change over by its name, so none sees a half."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")


def truncated(rows: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return rows.limit(0)
