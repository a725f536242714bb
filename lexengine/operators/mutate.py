"""Mutations as functions from a snapshot to the next one, with the outcome of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexengine.functions.checks import ConflictError, NotFoundError
from lexengine.functions.text import normalize_key

ADDED, SKIPPED, NOT_FOUND = "added", "skipped", "not_found"
CREATED, UPDATED, REMOVED, REJECTED = "created", "updated", "removed", "rejected"


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table has not; of rows that repeat a key one is inserted."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def import_valid(table: DataFrame, rows: DataFrame, key: list[str], problem: Column) -> tuple[DataFrame, DataFrame]:
    """The table with new valid rows, and the rows that were rejected with their reason.

    problem is a text where a row is bad, else null. Rows whose key is there already are skipped, not rejected.
    """
    checked = rows.withColumn("problem", problem)
    good = checked.filter(F.col("problem").isNull()).drop("problem")
    return insert_missing(table, good, key), checked.filter(F.col("problem").isNotNull())


def create_unique(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with new rows; a key that is there already, or that repeats, is a conflict and nothing is created.

    The keys of a request are few; this runs the check at once, as its answer is an error or a table.
    """
    asked = rows.select(*key)
    taken = asked.join(table.select(*key), key, "left_semi").limit(1).count()
    if taken or asked.distinct().count() < asked.count():
        raise ConflictError(f"{', '.join(key)} must be unique")
    return table.unionByName(rows)


def create_outcomes(table: DataFrame, rows: DataFrame, key: list[str], again: str = SKIPPED) -> DataFrame:
    """Each requested row with its status: created if its key is new, else `again`; (key, seq, status).

    Of rows that repeat a key the one with the smallest seq is created.
    """
    first = rows.groupBy(*key).agg(F.min("seq").alias("first"))
    known = table.select(*key).distinct().withColumn("there", F.lit(True))
    found = rows.join(first.join(known, key, "left"), key)
    status = F.when(F.col("there") | (F.col("seq") > F.col("first")), again).otherwise(CREATED)
    return found.select(*key, "seq", status.alias("status"))


def seed_categories(categories: DataFrame, members: DataFrame, seeds: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, members, outcomes) after seeding with (seq, id, name, word).

    A category that is there counts as updated, but keeps its row; its words are added in any case. Words that the lexicon
    has not are left out.
    """
    own = seeds.groupBy("name").agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq"))
    outcomes = create_outcomes(categories, own, ["name"], UPDATED)
    grown = categories.unionByName(own.join(categories.select("name"), "name", "left_anti").select("id", "name"))
    wanted = seeds.join(grown.select("name", F.col("id").alias("category_id")), "name").join(words.select("word", "word_id"), "word")
    return grown, insert_missing(members, wanted.select("category_id", "word_id"), ["category_id", "word_id"]), outcomes


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows take the place of those with their key; the columns are the table's. Keys of rows are unique."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete_obsolete(categories: DataFrame, names: list[str], rules: DataFrame) -> DataFrame:
    """The categories without those of the given legacy names that no rule has."""
    current = rules.select("name").distinct().withColumn("current", F.lit(True))
    found = categories.join(current, "name", "left")
    return found.filter(~F.col("name").isin(names) | F.col("current").isNotNull()).select(*categories.columns)


def stamped(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """M4: rows with created_at, where there is none, and updated_at, both at the time of the statement or at the given one."""
    now = F.current_timestamp() if now is None else now
    created = F.coalesce("created_at", now) if "created_at" in rows.columns else now
    return rows.withColumns({"created_at": created, "updated_at": now})


def write_back(table: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Column filled, where it is null, from found (key, column); a job of its own, as reads change nothing.

    found has one row per key.
    """
    known = found.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    joined = table.join(known, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce(column, "_value")).select(*table.columns)


def import_entry(tables: dict[str, DataFrame], entry: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Words and keyed children are inserted if absent, definitions are always appended."""
    keys = {"words": ["word"], "pronunciations": ["word_id", "accent"], "word_forms": ["word_id", "form_type"], "synonyms": ["word_id", "synonym_word"]}
    out = dict(tables)
    for name, rows in entry.items():
        out[name] = insert_missing(tables[name], rows, keys[name]) if name in keys else tables[name].unionByName(rows)
    return out


def add_outcomes(requests: DataFrame, words: DataFrame, members: DataFrame) -> DataFrame:
    """Each request (seq, word) with its status; a repeat of an added word is skipped."""
    # A word's first request is aggregated before the shuffle, so a word that is asked for very often is no window.
    first = requests.groupBy("word").agg(F.min("seq").alias("first"))
    own = members.select("word_id").distinct().withColumn("member", F.lit(True))
    known = first.join(words.select("word", "word_id"), "word", "left").join(own, "word_id", "left")
    found = requests.join(known, "word")
    repeat = F.col("seq") > F.col("first")
    status = F.when(F.col("word_id").isNull(), NOT_FOUND).when(F.col("member") | repeat, SKIPPED).otherwise(ADDED)
    return found.select("seq", "word", "word_id", status.alias("status"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Requests per status."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def user_import(lists: DataFrame, requests: DataFrame) -> DataFrame:
    """(user_id, word) that a bulk import adds: normalised, blanks ignored, known words and repeats skipped."""
    rows = requests.select("user_id", normalize_key(F.col("word")).alias("word")).filter(F.col("word") != "")
    return rows.distinct().join(lists.select("user_id", "word"), ["user_id", "word"], "left_anti")


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns of the rows that fulfil a condition; a null condition changes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def fill_missing(table: DataFrame, column: str, value: Column) -> DataFrame:
    """A value where there is none."""
    return table.withColumn(column, F.coalesce(column, value))


def delete_rows(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table without the rows of the given keys; unknown keys do nothing."""
    return table.join(rows.select(*key), key, "left_anti")


def remove_outcomes(table: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """Each request (key) with its status: removed, or not_found where the table has no such row."""
    there = table.select(*key).distinct().withColumn("there", F.lit(True))
    return requests.select(*key).join(there, key, "left").select(*key, F.when(F.col("there"), REMOVED).otherwise(NOT_FOUND).alias("status"))


def remove_one(table: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that fulfil a condition; none is an error, so this looks at once."""
    hit = F.coalesce(condition, F.lit(False))
    if table.filter(hit).limit(1).count() == 0:
        raise NotFoundError("nothing to remove")
    return table.filter(~hit)


def delete_like(table: DataFrame, column: str, markers: tuple[str, ...]) -> DataFrame:
    """The table without rows that contain a marker; nulls stay."""
    return table.filter(F.coalesce(~contains_any(F.col(column), markers), F.lit(True)))


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    """F8: the markers are literal text."""
    found = F.lit(False)
    for m in markers:
        found = found | c.contains(m)
    return found


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children of the parents that are left."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def orphan(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children stay and lose the name of a parent that is gone."""
    known = parents.select(F.col(parent_key).alias("_known")).distinct()
    return children.join(known, children[key] == known["_known"], "left").withColumn(key, F.col("_known")).drop("_known")
