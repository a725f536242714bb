"""Word lookup as a nested document, and what picks single children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_word(words: DataFrame, text: str) -> DataFrame:
    """the word itself or its normalised form; of several the one with the smallest id (Q19)."""
    return words.filter((F.col("word") == text) | (F.col("word_normalized") == text)).orderBy("id").limit(1)


def nested(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Per key the children as an array of structs in order. Children of one parent meet in one row, as the result does."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def last_wins(rows: DataFrame, key: list[str], name: str, value: str, order: list[str]) -> DataFrame:
    """A10: of repeated names of a key, the last value counts."""
    return rows.groupBy(*key, name).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_match(rows: DataFrame, key: str, wanted: Column, order: list[str]) -> DataFrame:
    """Per key the first row that is wanted, else the first one."""
    best = F.min_by(F.struct("*"), F.struct(F.when(wanted, 0).otherwise(1).alias("unwanted"), *order))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def lookup(words: DataFrame, definitions: DataFrame, examples: DataFrame, pronunciations: DataFrame, forms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One nested document per word.

    Every child table is nested on its own before it is joined, so children do not multiply.
    Arrays without members and empty maps are null.
    """
    texts = nested(examples, "definition_id", ["id"], ["example_en", "example_vi"], "examples")
    full = definitions.join(texts, definitions.id == texts.definition_id, "left").drop("definition_id")
    parts = [
        nested(full, "word_id", ["definition_order", "id"], ["part_of_speech", "definition_en", "definition_vi", "level", "examples"], "definitions"),
        nested(pronunciations, "word_id", ["id"], ["accent", "ipa", "audio_url"], "pronunciations"),
        nested(synonyms, "word_id", ["id"], ["synonym_word"], "synonyms"),
        last_wins(forms, ["word_id"], "form_type", "form_word", ["id"]).groupBy("word_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("form_type", "form_word")))).alias("word_forms")),
    ]
    found = words.select("id", "word", "frequency_rank")
    for part in parts:
        found = found.join(part, found.id == part.word_id, "left").drop("word_id")
    return found
