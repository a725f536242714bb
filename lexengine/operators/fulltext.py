"""Search in texts by an inverted index: the best texts for some words, and texts that hold a phrase."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexengine.session import scratch_dir

#: The usual constants of BM25: how fast repeats stop counting, and how much a text's length counts.
K1, B = 1.2, 0.75
#: Postings lie in levels of impact; texts that are scored for a first bound, per result wanted.
LEVELS, FIRST = 32, 4
#: Digits to which a word's part of a score is rounded, so that sums are exact.
DIGITS = 6
#: Texts whose words are put in order together.
TEXTS = 1000
#: Words of queries that are sent to all tasks; more meet the postings in a shuffle.
SENT = 1_000_000
#: Scores that one task sums up at about, and the most tasks for that.
SCORES, SHARES = 1 << 20, 4096


def tokens(text: Column) -> Column:
    """The runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _grouped(t: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts in order of word and text: each word of each text, the number of the text, where its places begin (and an end), and all places."""
    sizes = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = t.flatten().dictionary_encode()
    names = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(names), np.int64)
    rank[names.to_numpy()] = np.arange(len(names))
    key = rank[coded.indices.to_numpy()] * len(t) + np.repeat(np.arange(len(t)), sizes)
    order = np.argsort(key, kind="stable")
    places = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].astype(np.int32)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    terms = coded.dictionary.take(names).take(pa.array(key[first] // len(t)))
    return terms.cast(pa.string()), key[first] % len(t), np.append(first, len(key)), places


def _sharded(words: DataFrame, columns: list[StructField], rows: Callable) -> DataFrame:
    """A written table of rows(doc, t) of words (doc, t): each task turns the texts it has around, so that no posting moves."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                yield rows(part.column(0), part.column(1))

    return _stored(words.mapInArrow(found, StructType([StructField("term", StringType()), StructField("doc", words.schema["doc"].dataType), *columns])))


@dataclass(frozen=True)
class TextIndex:
    """postings (term, level, doc, impact) of a number of texts."""

    postings: DataFrame
    texts: int

    @property
    def terms(self) -> DataFrame:
        """(term, idf, most): rarity and greatest impact of each word."""
        df = F.count(F.lit(1))
        return self.postings.groupBy("term").agg(F.log(1 + (F.lit(self.texts) - df + 0.5) / (df + 0.5)).alias("idf"), F.max("impact").alias("most"))


def text_index(texts: DataFrame) -> TextIndex:
    """The index of texts (doc, text), written as a table.

    A word's impact in a text is its part of BM25 without the word's rarity; levels are equal steps up to the greatest impact there is. The index is parted
    by texts: each task writes the postings of its own, in order of words. Texts that share a doc are one text after the other, and are the only thing that is
    shuffled. Null texts are empty and are in no posting, but count among all texts. Null docs are left out.
    """
    whole = texts.filter("doc IS NOT NULL").groupBy("doc").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))

    def rows(docs: pa.Array, t: pa.ListArray) -> pa.RecordBatch:
        terms, text, begins, _ = _grouped(t)
        sizes = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int32)
        # A row without a word tells of each text that it is there.
        text, tf = np.append(text, np.arange(len(t))), np.append(np.diff(begins), np.zeros(len(t))).astype(np.int32)
        terms = pa.concat_arrays([terms, pa.nulls(len(t), pa.string())])
        return pa.RecordBatch.from_arrays([terms, docs.take(pa.array(text)), pa.array(tf), pa.array(sizes[text])], ["term", "doc", "tf", "size"])

    counted = _sharded(whole.select("doc", tokens(F.col("text")).alias("t")), [StructField("tf", IntegerType()), StructField("size", IntegerType())], rows)
    # One row; its two numbers are plain values from here on.
    n, mean = counted.filter("term IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("size") / F.lit(mean or 1.0))
    impact = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)
    level = F.least(F.floor(impact / F.lit(K1 + 1) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    return TextIndex(counted.filter("term IS NOT NULL").select("term", level.alias("level"), "doc", impact.alias("impact")), n)


def _sent(words: DataFrame, asked: int) -> DataFrame:
    """Words of queries, to be sent to all tasks unless all queries have too many."""
    return F.broadcast(words) if asked <= SENT else words


def _summed(parts: DataFrame) -> DataFrame:
    """(query, doc, score) from parts of scores, which are whole numbers of the last digit."""
    return parts.groupBy("query", "doc").agg((F.sum("part") / F.lit(10.0**DIGITS)).alias("score"))


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def best_texts(index: TextIndex, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query, place, doc, score): the `top` texts of each query (query, text) by BM25, equal scores by doc; without a common word a text is not found.

    Only postings of the queries' words are kept, and dealt out by their texts; so all parts of a text's scores meet in one task, and no pair of a query and a
    text leaves it that is below the query's bound. Repeated words of a query count once, null and empty queries find nothing.
    """
    asked = _stored(queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct())
    kept = _stored(index.postings.join(_sent(asked.select("term").distinct(), asked.count()), "term", "left_semi"))
    own = TextIndex(kept, index.texts)
    asked = _stored(asked.join(own.terms, "term"))
    return _best(_candidates(own, asked, top), top).select("query", "place", "doc", "score")


def _candidates(index: TextIndex, asked: DataFrame, top: int) -> DataFrame:
    """(query, doc, score): all texts that are among the first `top` of a query, few others.

    Texts of the highest levels of a query's rarest words are scored first, until there are FIRST times `top`; their place number `top` is the bound.
    """
    words = asked.count()
    levels = index.postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("docs"), F.max("impact").alias("most"))
    own = asked.select("query", "term", "idf").join(levels, "term")
    down = Window.partitionBy("query").orderBy(F.desc(F.col("idf") * F.col("most")), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    # A query has as many rows here as its words have levels.
    first = own.withColumn("before", F.coalesce(F.sum("docs").over(down), F.lit(0))).filter(F.col("before") < FIRST * top).select("query", "term", "level")
    start = index.postings.join(_sent(first, words), ["term", "level"]).select("query", "doc").distinct()
    part = F.round(F.round(F.col("idf") * F.col("impact"), DIGITS) * 10**DIGITS).cast("long")
    parts = index.postings.join(_sent(asked.select("term", "idf").distinct(), words), "term").select("term", "doc", part.alias("part"))
    near = start.join(asked.select("query", "term"), "query").join(parts, ["term", "doc"])
    reached = _best(_summed(near), top).filter(F.col("place") == top).select("query", F.col("score").alias("least"))
    # A text's parts meet by its doc, so sums need no second shuffle.
    queries = asked.select("query").distinct()
    shares = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(SHARES, index.texts * queries.count() // SCORES))
    scored = _summed(parts.repartition(shares, "doc").join(_sent(asked.select("query", "term"), words), "term"))
    bounds = queries.join(reached, "query", "left").select("query", F.coalesce("least", F.lit(0.0)).alias("least"))
    return scored.join(_sent(_stored(bounds), words), "query").filter(F.col("score") >= F.col("least")).select("query", "doc", "score")


# --- phrases ------------------------------------------------------------------------------------


def positions(texts: DataFrame) -> DataFrame:
    """(term, doc, at): where each word stands in each text (doc, text), as a written table; null texts and docs are left out.

    Docs are different. The index is parted by texts: each task writes the places of its own, in order of words, so nothing is shuffled.
    """

    def rows(docs: pa.Array, t: pa.ListArray) -> pa.RecordBatch:
        terms, text, begins, places = _grouped(t)
        at = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(places))
        return pa.RecordBatch.from_arrays([terms, docs.take(pa.array(text)), at], ["term", "doc", "at"])

    words = texts.filter("doc IS NOT NULL AND text IS NOT NULL").select("doc", tokens(F.col("text")).alias("t"))
    return _sharded(words, [StructField("at", ArrayType(IntegerType()))], rows)


def phrase_places(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, doc, start): every place (number of its first word) where the words of a phrase (phrase, text) follow each other.

    The places of a phrase's rarest word are shifted to where the phrase would begin; the positions of the next rarer word, shifted too, are
    intersected with them, and at last those of all others. Of the index only the words of that step move. A word that no text has ends the search.
    Phrases without words are found nowhere.
    """
    words = _stored(phrases.select("phrase", F.posexplode(tokens(F.col("text"))).alias("nth", "term")).distinct())
    asked = words.count()
    of = lambda some: index.join(_sent(some.select("term").distinct(), asked), "term", "left_semi")
    holders = of(words).groupBy("term").agg(F.sum(F.size("at")).alias("holders"))
    ranked = words.join(holders, "term", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    order = Window.partitionBy("phrase").orderBy("holders", "nth")
    everything = Window.partitionBy("phrase")
    ranked = _stored(ranked.withColumn("turn", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(everything)).withColumn("least", F.min("holders").over(everything)).filter("least > 0").drop("least", "holders"))
    shifted = index.join(_sent(ranked.filter("turn = 1"), asked), "term").select("phrase", "size", "doc", F.explode(F.transform("at", lambda x: x - F.col("nth"))).alias("start")).filter("start >= 0")
    for turns in ("turn = 2", "turn > 2"):
        wanted = ranked.filter(turns).select("phrase", "nth", "term")
        more = shifted.join(_sent(wanted, asked), "phrase").join(of(wanted), ["term", "doc"])
        hits = more.filter(F.array_contains("at", F.col("start") + F.col("nth"))).groupBy("phrase", "doc", "start").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("hits"))
        met = hits.filter("hits = 1" if turns == "turn = 2" else "hits = size - 2")
        short = shifted.filter("size < 2" if turns == "turn = 2" else "size < 3")
        shifted = short.select("phrase", "size", "doc", "start").unionByName(met.select("phrase", "size", "doc", "start"))
    return shifted.select("phrase", "doc", "start")
