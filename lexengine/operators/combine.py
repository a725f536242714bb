"""Merging the corpora by word and normalising the result into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.functions.text import level

MAX_SYNONYMS = 10


def combine(wiktionary: DataFrame, cmu: DataFrame, wordnet: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """One record per word.

    Words of the dictionary that have definitions get what the other two know of them; one without a US
    pronunciation takes that of the pronouncing dictionary besides its own. Words of the pronouncing
    dictionary that are not in yet come in if they have synonyms. ranks (word, frequency_rank) is optional.
    """
    spoken = F.array(F.struct(F.lit("US").alias("accent"), F.col("ipa").alias("ipa")))
    net = wordnet.select("word", F.slice("synonyms", 1, MAX_SYNONYMS).alias("synonyms"), "word_forms")
    # One join for both kinds of words, so each source is read and parsed once.
    both = wiktionary.filter(F.size("definitions") > 0).join(cmu.select("word", "ipa"), "word", "full_outer").join(net, "word", "left")
    known = F.col("definitions").isNotNull()
    enough = F.exists("pronunciations", lambda p: p.accent == "US") | F.col("ipa").isNull()
    said = F.when(~known, spoken).when(enough, F.col("pronunciations")).otherwise(F.concat("pronunciations", spoken))
    none = F.array().cast(both.schema["definitions"].dataType)
    rows = both.filter(known | (F.size("synonyms") > 0)).select("word", said.alias("pronunciations"), F.coalesce("definitions", none).alias("definitions"), "synonyms", "word_forms")
    rows = rows.withColumn("frequency_rank", F.lit(None).cast("int")) if ranks is None else rows.join(ranks, "word", "left")
    rows = rows.withColumns({"word_normalized": F.lower("word"), "language": F.lit("en")})
    tagged = F.transform("definitions", lambda d: d.withField("level", level(F.col("frequency_rank"), F.col("word"))))
    return rows.withColumn("definitions", tagged)


def rank_list(spark: SparkSession, words: list[str]) -> DataFrame:
    """(word, frequency_rank) of a list of words, the most frequent first; of a word that repeats the first place counts."""
    places: dict[str, int] = {}
    for i, w in enumerate(words, 1):
        places.setdefault(w, i)
    return spark.createDataFrame(list(places.items()), "word string, frequency_rank int")


def ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows with their word's rank, 0 where the list has none."""
    return rows.join(ranks, "word", "left").withColumn("frequency_rank", F.coalesce("frequency_rank", F.lit(0)))


def in_order(rows: DataFrame) -> DataFrame:
    """Ranked words by rank, then the others by word; rank 0 counts as none."""
    return rows.orderBy(F.when(F.col("frequency_rank") > 0, F.col("frequency_rank")).asc_nulls_last(), "word")


def _key(*parts: str) -> Column:
    """An identifier from what names a row, so that reruns and other plans give the same."""
    return F.xxhash64(*parts)


def normalize(records: DataFrame) -> dict[str, DataFrame]:
    """The tables of nested records; orders count from 1."""
    rows = records.withColumn("word_id", _key("word"))
    defs = rows.select("word_id", F.posexplode("definitions").alias("i", "d")).withColumn("id", _key("word_id", "i"))
    return {
        "words": rows.select(F.col("word_id").alias("id"), "word", "language", "word_normalized", "frequency_rank", F.transform("definitions", lambda d: d.pos).alias("part_of_speech")),
        "definitions": defs.select("id", "word_id", F.col("d.pos").alias("part_of_speech"), F.col("d.definition_en").alias("definition_en"), F.col("d.level").alias("level"), (F.col("i") + 1).alias("definition_order")),
        "examples": defs.select(F.col("id").alias("definition_id"), F.posexplode("d.examples").alias("i", "e")).select(_key("definition_id", "i").alias("id"), "definition_id", F.col("e.en").alias("example_en")),
        "pronunciations": rows.select("word_id", F.posexplode("pronunciations").alias("i", "p")).select(_key("word_id", "i").alias("id"), "word_id", F.col("p.accent").alias("accent"), F.col("p.ipa").alias("ipa")),
        "synonyms": rows.select("word_id", F.posexplode("synonyms").alias("i", "s")).select(_key("word_id", "i").alias("id"), "word_id", F.col("s").alias("synonym_word")),
        "word_forms": rows.select("word_id", F.explode("word_forms").alias("form_type", "form_word")).select(_key("word_id", "form_type").alias("id"), "word_id", "form_type", "form_word"),
    }


def definition_order(rows: DataFrame, key: str, texts: str) -> DataFrame:
    """The members of an array with their places, from 1."""
    return rows.select(key, F.posexplode(texts).alias("i", "definition")).select(key, (F.col("i") + 1).alias("definition_order"), "definition")
