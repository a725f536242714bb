"""Calls to the outside behind plain functions: translation, replies, recordings.

The callers pass the client in; nothing here opens a connection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.functions.text import audio_accent, preferred_audio

#: Parts of a fetched entry that are kept.
MEANINGS, DEFINITIONS, SYNONYMS = 3, 2, 5


class TranslationError(RuntimeError):
    pass


def with_fallback(first: Callable[[str], str], second: Callable[[str], str]) -> Callable[[str], str]:
    """Any failure of the first is answered by the second; a failure of both is an error."""

    def translate(text: str) -> str:
        for client in (first, second):
            try:
                return client(text)
            except Exception as e:  # noqa: BLE001  a client may raise anything
                last = e
        raise TranslationError("translation failed") from last

    return translate


def translate_missing(rows: DataFrame, source: str, target: str, translate: Callable[[str], str]) -> DataFrame:
    """Fills target where it is null. Only rows that lack it reach Python."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[target] = [None if t is None else translate(t) for t in batch[source]]
            yield batch

    missing = rows.filter(F.col(target).isNull() & F.col(source).isNotNull())
    there = rows.filter(F.col(target).isNotNull() | F.col(source).isNull())
    return there.unionByName(missing.mapInPandas(fill, rows.schema))


def parse_reply(reply: str) -> dict:
    """The JSON object in a reply, from the first brace to the last."""
    start, end = reply.find("{"), reply.rfind("}")
    try:
        if start < 0 or end < start:
            raise ValueError
        return json.loads(reply[start : end + 1])
    except ValueError as e:
        raise ValueError("Failed to parse dictionary data") from e


def parse_sentences(reply: str, n: int) -> list[str]:
    """The first n lines of more than 10 characters."""
    found = [s for line in reply.split("\n") if len(s := line.strip()) > 10][:n]
    if not found:
        raise ValueError("Failed to generate sentences")
    return found


def fetched_entry(reply: list[dict]) -> dict:
    """What is kept of a fetched dictionary entry: the first one, cut to a few meanings."""
    first = reply[0]
    meanings = first.get("meanings", [])[:MEANINGS]
    return {
        "word": first["word"],
        "definitions": [{"pos": m["partOfSpeech"], "definition_en": d["definition"]} for m in meanings for d in m.get("definitions", [])[:DEFINITIONS]],
        "synonyms": list(dict.fromkeys(s for m in meanings for s in m.get("synonyms", [])))[:SYNONYMS],
    }


FETCHED = "word string, definitions array<struct<pos string, definition_en string>>, synonyms array<string>, problem string"


def fetch_entries(words: DataFrame, fetch: Callable[[str], list[dict]]) -> DataFrame:
    """What the client knows of each word of words (word), fetched by tasks, as rows of FETCHED.

    A word that the client fails on has a row that tells the problem, so one failure stops nothing. Null words are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word in batch["word"]:
                try:
                    out.append(fetched_entry(fetch(word)) | {"word": word, "problem": None})
                except Exception as e:  # noqa: BLE001  a client may raise anything
                    out.append({"word": word, "definitions": None, "synonyms": None, "problem": str(e) or type(e).__name__})
            yield pd.DataFrame(out, columns=["word", "definitions", "synonyms", "problem"])

    return words.select("word").filter(F.col("word").isNotNull()).mapInPandas(rows, FETCHED)


def recordings(audio: DataFrame) -> DataFrame:
    """Per word the first US and UK recording of (word, seq, url), and the one to play for each wish.

    A recording without an accent counts as US for a word that has no recording with one.
    """
    rows = audio.withColumn("accent", audio_accent(F.col("url")))
    pick = lambda accent: F.min_by(F.when(accent, F.col("url")), F.when(accent, F.col("seq")))
    found = rows.groupBy("word").agg(pick(F.col("accent") == "us").alias("us"), pick(F.col("accent") == "uk").alias("uk"), pick(F.col("accent").isNull()).alias("other"))
    found = found.withColumn("us", F.coalesce("us", F.when(F.col("uk").isNull(), F.col("other"))))
    return found.select("word", "us", "uk", preferred_audio(F.col("us"), F.col("uk"), "US").alias("for_us"), preferred_audio(F.col("us"), F.col("uk"), "UK").alias("for_uk"))
