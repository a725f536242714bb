"""Synsets and exception lists of a word net."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.functions.text import inflection, strip
from lexengine.sources.cmudict import file_order

PARTS_OF_SPEECH = ("noun", "verb", "adj", "adv")


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(pos, line, value) of one file per part of speech; files that are missing are empty."""
    found = []
    for pos in PARTS_OF_SPEECH:
        try:
            rows = spark.read.text(f"{folder}/{name.format(pos=pos)}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found.append(rows.select(F.lit(pos).alias("pos"), file_order(rows).alias("line"), "value"))
    line = "struct<file:string,file_block_start:bigint,number:bigint>"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"pos string, line {line}, value string")


def read_synsets(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "data.{pos}")


def read_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "{pos}.exc")


def hex_count(c: Column) -> Column:
    """M1: a hexadecimal number, null if it is none."""
    return F.when(c.rlike(r"^[0-9A-Fa-f]+\z"), F.conv(c, 16, 10).cast("int"))


def synset_words(lines: DataFrame) -> DataFrame:
    """(pos, line, words): the lower-cased members of each synset, by the count that the line declares."""
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("  "))
    tokens = F.split(strip(F.get(F.split("value", r"\|"), F.lit(0))), r"\s+")
    # Split once for each line: what is exploded is not computed anew wherever it is used, as any other column would be, in functions of each member too.
    rows = rows.select("pos", "line", F.explode(F.array(tokens)).alias("t"))
    rows = rows.withColumn("n", hex_count(F.get("t", F.lit(3)))).filter("n > 0")
    # Members stand at every second place from the fifth on; a line may end early.
    members = F.filter(F.slice("t", F.lit(5), F.col("n") * 2), lambda _, i: i % 2 == 0)
    return rows.select("pos", "line", F.transform(members, lambda w: F.lower(F.replace(w, F.lit("_"), F.lit(" ")))).alias("words"))


def synonyms(synsets: DataFrame) -> DataFrame:
    """(word, synonyms) over all synsets and parts of speech; words of several parts take no part.

    Synonyms keep the order in which they are first seen. A synset is small, so a word's own
    list comes from its row; lists of a word are merged over all its synsets.
    """
    single = synsets.select("pos", "line", F.filter("words", lambda w: ~w.contains(" ")).alias("words"))
    rank = F.element_at(F.create_map(*[x for i, p in enumerate(PARTS_OF_SPEECH) for x in (F.lit(p), F.lit(i))]), F.col("pos"))
    own = single.select(rank.alias("rank"), "line", F.explode(F.array_distinct("words")).alias("word"), "words")
    own = own.withColumn("others", F.array_remove("words", F.col("word")))
    # Most words are rare in a task, so lists are made behind the shuffle and not before it too.
    merged = own.repartition("word").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rank", "line", "others"))).alias("lists"))
    return merged.select("word", F.array_distinct(F.flatten("lists.others")).alias("synonyms"))


def word_forms(lines: DataFrame) -> DataFrame:
    """(word, word_forms) by first lemma; of several forms of one kind the last line counts."""
    parts = F.split(strip(F.col("value")), r"\s+")
    rows = lines.select("pos", "line", F.get(parts, F.lit(0)).alias("form"), F.get(parts, F.lit(1)).alias("word")).filter("word is not null")
    rows = rows.withColumn("kind", inflection(F.col("form"), F.col("pos"))).filter("kind is not null")
    rank = F.element_at(F.create_map(*[x for i, p in enumerate(PARTS_OF_SPEECH) for x in (F.lit(p), F.lit(i))]), F.col("pos"))
    last = rows.groupBy("word", "kind").agg(F.max_by("form", F.struct(rank, "line")).alias("form"))
    return last.groupBy("word").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "form")))).alias("word_forms"))


def parse(synset_lines: DataFrame, exception_lines: DataFrame) -> DataFrame:
    """C14: (word, synonyms, word_forms); words known from one side only have null on the other."""
    return synonyms(synset_words(synset_lines)).join(word_forms(exception_lines), "word", "full")
