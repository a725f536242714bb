"""The pronouncing dictionary: lines of a word and its phones."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.functions.text import arpabet_to_ipa, strip


def file_order(lines: DataFrame) -> Column:
    """The place of a line read from files: its file, the part of the file that a task reads, and its number there.

    Files of one folder are told apart by their names alone, since places travel with the rows.
    """
    path = F.col("_metadata.file_path")
    file = F.substring_index(path, "/", -1) if len({os.path.dirname(f) for f in lines.inputFiles()}) < 2 else path
    return F.struct(file.alias("file"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("number"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): text lines in the order of file names and of the lines in a file; line is any value that sorts so."""
    lines = spark.read.text(path)
    return lines.select(file_order(lines).alias("line"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """(word, pronunciation, ipa) of lines (line, value).

    Comments and blank lines are skipped. Of lines of one word the last one without a variant number counts, else the
    first variant. Variant numbers are known behind upper-case words only; any other number breaks the
    word's spelling, and such words are dropped.
    """
    rows = lines.filter(~F.col("value").startswith(";;;") & (strip(F.col("value")) != ""))
    parts = F.split("value", " ", 2)
    rows = rows.select("line", F.get(parts, F.lit(0)).alias("raw"), strip(F.get(parts, F.lit(1))).alias("pronunciation")).filter("pronunciation is not null and pronunciation <> ''")
    variant = F.col("raw").rlike(r"^[A-Z'-]+\(\d+\)\z")
    rows = rows.withColumns({"variant": variant, "word": F.lower(F.when(variant, F.regexp_extract("raw", r"^([A-Z'-]+)\(", 1)).otherwise(F.col("raw")))})
    rows = rows.filter(F.col("word").rlike(r"^[a-z'-]+\z"))
    plain = F.max_by(F.when(~F.col("variant"), F.col("pronunciation")), F.when(~F.col("variant"), F.col("line")))
    other = F.min_by(F.when(F.col("variant"), F.col("pronunciation")), F.when(F.col("variant"), F.col("line")))
    first = rows.groupBy("word").agg(F.coalesce(plain, other).alias("pronunciation"))
    return first.select("word", "pronunciation", arpabet_to_ipa(F.col("pronunciation")).alias("ipa"))
