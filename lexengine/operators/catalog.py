"""Categories: lists, counts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.functions import checks
from lexengine.functions.checks import NotFoundError
from lexengine.operators.lookup import nested


def topic_list(categories: DataFrame) -> DataFrame:
    """Categories per topic."""
    return categories.groupBy("topic").agg(F.count("id").alias("category_count"))


def filtered(categories: DataFrame, topic: str | None = None, parent_only: bool = False) -> DataFrame:
    """filters that apply only if given."""
    if topic is not None:
        categories = categories.filter(F.col("topic") == topic)
    return categories.filter(F.col("parent_id").isNull()) if parent_only else categories


def category_list(categories: DataFrame, members: DataFrame, topic: str | None = None, parent_only: bool = False) -> DataFrame:
    """Each category with its words and its children counted.

    Both sides are counted before they are joined, so they cannot multiply each other.
    """
    words = members.groupBy("category_id").agg(F.countDistinct("word_id").alias("word_count"))
    children = categories.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("parent")).agg(F.countDistinct("id").alias("subcategory_count"))
    found = filtered(categories, topic, parent_only)
    found = found.join(words, found.id == words.category_id, "left").join(children, found.id == children.parent, "left")
    zero = F.lit(0).cast("long")
    return found.select("id", "name", "topic", F.coalesce("word_count", zero).alias("word_count"), F.coalesce("subcategory_count", zero).alias("subcategory_count"))


def subcategories(categories: DataFrame, members: DataFrame, parent_id: int) -> DataFrame:
    """The children of a category with their words counted, those without words too."""
    words = members.groupBy("category_id").agg(F.count("word_id").alias("word_count"))
    own = categories.filter(F.col("parent_id") == parent_id)
    return own.join(words, own.id == words.category_id, "left").select("id", "name", F.coalesce("word_count", F.lit(0).cast("long")).alias("word_count"))


def in_display_order(categories: DataFrame, *more: str) -> DataFrame:
    """T4: by display order, then display name; null orders come last."""
    return categories.orderBy(F.col("display_order").asc_nulls_last(), "display_name", *more)


def resolve(categories: DataFrame, reference: object) -> DataFrame:
    """the category whose id the reference is, if it is all digits, else the one of that name."""
    text = str(reference)
    return categories.filter(F.col("id") == int(text)) if text.isascii() and text.isdigit() else categories.filter(F.col("name") == text)


def required(categories: DataFrame, reference: object) -> DataFrame:
    """like resolve, but no such category is an error; looks at once."""
    found = resolve(categories, reference)
    if found.limit(1).count() == 0:
        raise NotFoundError(f"no category {reference}")
    return found


def category_page(categories: DataFrame, members: DataFrame, words: DataFrame, definitions: DataFrame, reference: object, number: object = None, size: object = None, search_text: str | None = None) -> DataFrame:
    """A page of a category's words with their definitions nested, and on each row the page's total, total_pages and has_more.

    Words stand by the display order of their membership, then by word (T5). Definitions are looked up for the words of
    the page alone. A page beyond the end has no rows.
    """
    number, size = checks.page(number, size)
    own = F.broadcast(resolve(categories, reference).select(F.col("id").alias("category_id"), F.col("name").alias("category")))
    rows = members.join(own, "category_id").join(words.select(F.col("id").alias("word_id"), "word", "frequency_rank"), "word_id")
    if search_text is not None:
        rows = search(rows, "word", search_text)
    cut = page(rows, [F.col("display_order").asc_nulls_last(), "word", "word_id"], number, size)
    meta = page_meta(rows, number, size)
    wanted = definitions.join(F.broadcast(cut.select("word_id")), "word_id", "left_semi")
    nested_rows = nested(wanted, "word_id", ["definition_order", "id"], ["part_of_speech", "definition_en"], "definitions")
    # One row of meta data, and a page of rows at most.
    return cut.join(nested_rows, "word_id", "left").crossJoin(F.broadcast(meta)).select("category", "word_id", "word", "frequency_rank", "display_order", "definitions", "total", "total_pages", "has_more")


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page by offset; order must end in a unique key. Only offset + size rows reach one task."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_meta(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Total, total_pages and has_more of a page."""
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"), (F.lit(number * size) < F.col("total")).alias("has_more")
    )


def search(words: DataFrame, column: str, text: str) -> DataFrame:
    """case-insensitive substring; % and _ in the text are wildcards."""
    return words.filter(F.col(column).ilike(f"%{text}%"))


def tree_detail(categories: DataFrame, members: DataFrame) -> DataFrame:
    """Each child category beside its parent, with the words of both."""
    words = members.groupBy("category_id").agg(F.countDistinct("word_id").alias("n"))
    zero = F.lit(0).cast("long")
    child, parent = categories.alias("c"), categories.select(F.col("id").alias("pid"), F.col("name").alias("parent_name"))
    found = child.join(parent, F.col("c.parent_id") == F.col("pid"))
    found = found.join(words.select(F.col("category_id").alias("a"), F.col("n").alias("child_words")), F.col("c.id") == F.col("a"), "left")
    found = found.join(words.select(F.col("category_id").alias("b"), F.col("n").alias("parent_words")), F.col("pid") == F.col("b"), "left")
    return found.select("parent_name", F.col("c.name").alias("child_name"), F.coalesce("child_words", zero).alias("child_words"), F.coalesce("parent_words", zero).alias("parent_words"))


def subcategory_summary(categories: DataFrame, members: DataFrame) -> DataFrame:
    """Per parent the number of children and of distinct words below it."""
    child = categories.filter(F.col("parent_id").isNotNull()).select(F.col("id").alias("cid"), "parent_id")
    below = child.join(members, child.cid == members.category_id, "left").groupBy("parent_id").agg(F.countDistinct("cid").alias("subcategories"), F.countDistinct("word_id").alias("words"))
    return categories.select("id", "name").join(below, F.col("id") == below.parent_id).select("name", "subcategories", "words")
