"""A corpus pipeline of five training-data operators over the documents table.

Quality classifier, exact deduplication, n-gram Jaccard join, mixing to target weights, best-fit
packing. Each stage takes what its predecessor kept, as a table that was written and read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm import exact_dedup, mixing, ngram_join, packing, quality
from lexengine.llm.common import in_arrow, join_hot, scratch, shared_dir, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels of these documents.

    Null and empty texts are judged like any other, and so is each of rows that repeat. A score of just 1/2 stays, so
    without labels of both kinds all documents stay. An empty table gives no rows; other columns are dropped.
    """
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, ranker, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null and empty texts equal each other; a null doc_id is smaller than any other. Of rows that share both text and
    doc_id the last by locator stays. Rows are found again by their locator, so that repeated rows are told apart too.
    An empty table gives no rows; other columns are dropped.
    """
    docs = exact_dedup.filed(docs.select(*COLUMNS))
    kept = exact_dedup.dedup(docs).filter("kept").select("loc")
    return exact_dedup.located(docs).join(kept, "loc", "left_semi").select(*COLUMNS)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the row with the smallest doc_id stays, of those the first by locator.

    A null doc_id is larger than any other. Rows are found again by their locator, so that rows
    with the same or no doc_id are told apart. Documents without words are similar to nothing and all stay. An empty
    table gives no rows; other columns are dropped.
    """
    docs = exact_dedup.located(docs.select(*COLUMNS))
    found = stored(ngram_join.similarity_join(docs, extra=["loc"]).filter("component IS NOT NULL").select("component", "doc_id", "loc"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "loc")).alias("first")
    several = stored(found.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1"))
    dropped = join_hot(found, several, "component", "n", found.count()).filter(F.col("loc") != F.col("first.loc")).select("loc")
    return docs.join(stored(dropped), "loc", "left_anti").select(*COLUMNS)


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each text after its first `words` words (the last column)."""
    for batch in batches:
        texts = [mixing.first_words(t.as_py() or "", n.as_py()) for t, n in zip(batch.column(1), batch.column(5), strict=True)]
        columns = [batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that is cut comes with its first words only.

    Documents without words, and with them null and empty texts, are taken 0 times. A null source is a source of its
    own. Rows with the same key are ordered by doc_id, size and locator. An empty table gives no rows; other columns
    are dropped.
    """
    docs = exact_dedup.located(docs.select(*COLUMNS))
    until = stored(mixing.ends(mixing.mix(docs, extra=["loc"]), ["loc"]))
    taken = mixing.taken_up_to(docs, until, ["loc"]).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    copies = taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(whole, F.lit(1).cast("long")))).alias("copy"), whole.alias("whole")).filter("copy <= whole")
    cut = taken.filter("taken % size > 0").select(*COLUMNS, (F.col("taken") % F.col("size")).alias("words"))
    return copies.select(*COLUMNS).unionByName(in_arrow(cut, _first_words, docs.select(*COLUMNS).schema))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences.

    A null or empty text is one piece, the end token; a null doc_id stays null; rows that repeat are packed each. An
    empty table gives no rows; other columns are ignored.
    """
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", dissimilar_documents),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_documents),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # The stage's own tables go when its result is written.
        result = shared_dir(spark)
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), result)
    return STAGES[-1][1](spark, docs, sf_dir)
