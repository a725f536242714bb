"""Coverage, audits and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexengine.functions.text import percent
from lexengine.operators.mutate import contains_any

# What templates leave behind in examples.
TEMPLATE_MARKERS = ("{{quote-text", "{{quote-book", "{{quote-journal", "{{quote-web", "{{quote-song", "{{ux|", "{{RQ:", "{{Q|")


def coverage(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with the number and the share of rows that fulfil each check."""
    total = F.count(F.lit(1))
    out = [total.alias("total")]
    for name, check in checks.items():
        n = F.coalesce(F.sum(F.when(check, 1).otherwise(0)), F.lit(0)).cast("long")
        out += [n.alias(f"with_{name}"), percent(n, total).alias(f"{name}_percent")]
    return rows.agg(*out)


def marker_counts(rows: DataFrame, column: str, markers: tuple[str, ...] = TEMPLATE_MARKERS) -> DataFrame:
    """Rows per marker; a row with two markers counts twice. One scan, one row out per task."""
    counts = rows.agg(*[F.coalesce(F.sum(F.when(F.col(column).contains(m), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"n{i}") for i, m in enumerate(markers)])
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"n{i}").alias("hits")) for i, m in enumerate(markers)])
    return counts.select(F.inline(pairs))


def residue(rows: DataFrame, column: str, markers: tuple[str, ...] = TEMPLATE_MARKERS) -> DataFrame:
    """F8: the rows with any marker."""
    return rows.filter(contains_any(F.col(column), markers))


def example_worklist(examples: DataFrame, definitions: DataFrame, words: DataFrame, limit: int | None = None) -> DataFrame:
    """Examples without a translation, those of the most frequent words first; words without a rank come last."""
    parents = definitions.select(F.col("id").alias("definition_id"), "word_id").join(words.select(F.col("id").alias("word_id"), "word", "frequency_rank"), "word_id", "left")
    missing = examples.filter(F.col("example_vi").isNull() & F.col("example_en").isNotNull()).join(parents, "definition_id", "left")
    return worklist(missing, F.lit(True), [F.col("frequency_rank").asc_nulls_last(), "definition_id", "id"], limit)


def worklist(rows: DataFrame, missing: Column, order: list, limit: int | None = None) -> DataFrame:
    """Rows that lack something, the most important first."""
    found = rows.filter(missing).orderBy(*order)
    return found if limit is None else found.limit(limit)
