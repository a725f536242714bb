"""Prefix search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.functions.text import normalize_key

# Words that are suggested when the lexicon has none.
COMMON_WORDS = (
    "hello", "world", "dictionary", "learn", "example", "language", "practice", "study", "vocabulary", "grammar", "pronunciation",
    "definition", "translation", "english", "vietnamese", "word", "sentence", "phrase", "meaning", "synonym", "antonym",
    "help", "helicopter", "history", "house", "home", "hand", "happy", "hard", "have", "heart", "heavy", "high", "hold",
)


def key_index(words: DataFrame, column: str = "word") -> DataFrame:
    """Adds the search key. Written in key order, a prefix reads few row groups only."""
    return words.withColumn("key", normalize_key(F.col(column)))


def write_index(indexed: DataFrame, path: str, files: int) -> None:
    """Range-partitions by key and sorts, so that a prefix filter is pushed down to few files."""
    indexed.repartitionByRange(files, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def _by_prefix(indexed: DataFrame, prefix: str) -> DataFrame:
    prefix = prefix.strip().lower()
    return indexed.filter(F.col("key").startswith(prefix)) if prefix else indexed.limit(0)


def autocomplete(indexed: DataFrame, prefix: str, limit: int = 15, rank_first: bool = False) -> DataFrame:
    """The first `limit` keys with a prefix, then by rank (Q1); rank_first looks at ranks before it cuts.

    A blank prefix gives nothing. Both forms keep `limit` rows per task only.
    """
    found = _by_prefix(indexed, prefix)
    by_rank = [F.col("frequency_rank").asc_nulls_last(), "key", "id"]
    return found.orderBy(*by_rank).limit(limit) if rank_first else found.orderBy("key", "id").limit(limit).orderBy(*by_rank)


def suggestions(indexed: DataFrame, prefix: str, limit: int = 15) -> DataFrame:
    """Autocomplete, or words of the fixed list if there is no hit; (word).

    Nothing runs before the rows are taken: the fixed words are joined against the hits, which are `limit` at most.
    """
    found = autocomplete(indexed, prefix, limit).select("word")
    wanted = prefix.strip().lower()
    fixed = [(w,) for w in COMMON_WORDS if wanted and w.startswith(wanted)][:limit]
    if not fixed:
        return found
    any_hit = F.broadcast(found.limit(1).select(F.lit(1).alias("hit")))
    rest = indexed.sparkSession.createDataFrame(fixed, "word string").withColumn("hit", F.lit(1))
    return found.unionByName(rest.join(any_hit, "hit", "left_anti").select("word"))


def hydrate(hits: DataFrame, pronunciations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each hit with its sounds (the first US ones, else the first) and its first definition's part of speech.

    Hits are few, so they are broadcast to the child tables, which are aggregated for those words only.
    """
    wanted = F.broadcast(hits.select(F.col("id").alias("word_id")).distinct())
    sound = pronunciations.join(wanted, "word_id", "left_semi").groupBy("word_id").agg(F.min_by("ipa", F.struct((F.col("accent") != "US").alias("other"), "id")).alias("ipa"))
    sense = definitions.join(wanted, "word_id", "left_semi").groupBy("word_id").agg(F.min_by("part_of_speech", F.struct("definition_order", "id")).alias("pos"))
    found = hits.join(sound, hits.id == sound.word_id, "left").drop("word_id")
    return found.join(sense, found.id == sense.word_id, "left").drop("word_id")


def category_autocomplete(categories: DataFrame, prefix: str, limit: int = 15) -> DataFrame:
    """C4: categories by name or display name; cut before repeats go (Q2), then by words and name."""
    keys = categories.select("id", "name", "display_name", "word_count", F.explode(F.array("name", "display_name")).alias("k"))
    hits = _by_prefix(keys.withColumn("key", normalize_key(F.col("k"))), prefix).orderBy("key", "id", "k").limit(limit)
    return hits.dropDuplicates(["id"]).select("id", "name", "display_name", "word_count").orderBy(F.desc("word_count"), "display_name", "id").limit(limit)


def topic_autocomplete(categories: DataFrame, prefix: str, limit: int = 15, exact: bool = False) -> DataFrame:
    """Topics with their categories counted among the first `limit` hits (Q3), or among all if exact."""
    hits = _by_prefix(categories.withColumn("key", normalize_key(F.col("topic"))), prefix)
    hits = hits if exact else hits.orderBy("key", "id").limit(limit)
    return hits.groupBy("topic").agg(F.count(F.lit(1)).alias("category_count"))


def user_words(lists: DataFrame, user, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """C11: a user's words in order; % and _ in the prefix are wildcards."""
    own = lists.filter(F.col("user_id") == user)
    if prefix is not None:
        own = own.filter(F.col("word").like(prefix + "%"))
    own = own.orderBy("word")
    return own if limit is None else own.limit(limit)
