"""Search that forgives: typing errors, wildcards, and words that sound alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexengine.session import scratch_dir

#: Letters by which a word is indexed for typing errors; of longer words the first ones.
INDEXED = 24
#: Marks of the beginning and the end of a key in grams, and stand-ins for escaped wildcards; no key should hold them.
START, END = "\u0002", "\u0003"
_ESCAPED = {"*": "\ufdd0", "?": "\ufdd1", "\\": "\ufdd2"}
GRAM = 3
#: What queries ask for is sent to all tasks up to so many rows; more meet the index by a shuffle.
SENT = 100_000


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _asking(asked: DataFrame) -> DataFrame:
    """A written table, to be joined with an index: sent to all tasks if it is small. The index never is, though it looks small to the planner, which does not see that exploded rows are many."""
    return F.broadcast(asked) if asked.count() <= SENT else asked.hint("merge")


# --- typing errors ------------------------------------------------------------------------------


def deletions(word: Column, most: int) -> Column:
    """The word and all that is left of it without up to `most` letters, each once."""

    def shorter(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(w), F.transform(places, lambda i: F.concat(w.substr(F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))

    found = F.array(word)
    for _ in range(most):
        found = F.array_distinct(F.flatten(F.transform(found, shorter)))
    return found


def typo_index(words: DataFrame, column: str = "key", distance: int = 2) -> DataFrame:
    """(word, variant): each different word of a column under the hashes of its variants with up to `distance` letters less.

    Words within `distance` edits share a variant. That holds for their first INDEXED letters too, so long words have no
    more variants than those. Null and empty words are left out. Written in order of variant, a lookup reads few row groups.
    """
    known = words.select(F.col(column).alias("word")).filter(F.length("word") > 0).distinct()
    return known.select("word", F.explode(deletions(F.substring("word", 1, INDEXED), distance)).alias("v")).select("word", F.xxhash64("v").alias("variant"))


def typo_matches(queries: DataFrame, index: DataFrame, column: str = "query", distance: int = 2) -> DataFrame:
    """(query, word, distance): every indexed word within `distance` edits (insert, delete, replace) of a query, each pair once.

    index comes from typo_index with at least this distance. Null and empty queries match nothing; repeated ones count once. Words that meet are
    compared exactly, and only if their lengths allow it. No two words meet that share no variant.
    """
    asked = typo_index(queries, column, distance).withColumnRenamed("word", "query")
    near = asked.join(index, "variant").filter(F.abs(F.length("query") - F.length("word")) <= distance).select("query", "word").distinct()
    return near.withColumn("distance", F.levenshtein("query", "word", distance)).filter(F.col("distance") >= 0)


def typo_suggestions(queries: DataFrame, words: DataFrame, top: int = 5, distance: int = 2) -> DataFrame:
    """(query, place, word, distance, rank): the `top` nearest words of each query, by distance, rank (none last) and word.

    words has key and rank; of a word that repeats the best rank counts.
    """
    ranks = words.filter(F.length("key") > 0).groupBy(F.col("key").alias("word")).agg(F.min("rank").alias("rank"))
    found = typo_matches(queries, typo_index(words, "key", distance), distance=distance).join(ranks, "word")
    order = Window.partitionBy("query").orderBy("distance", F.col("rank").asc_nulls_last(), "word")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("query", "place", "word", "distance", "rank")


# --- wildcards ----------------------------------------------------------------------------------


def _grams(text: Column, size: int) -> Column:
    """Runs of `size` characters; none if the text is shorter."""
    last = F.length(text) - (size - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def gram_index(words: DataFrame, column: str = "key") -> DataFrame:
    """(gram, key): each different key under its runs of one to GRAM characters, the marks of its ends included.

    Null keys are left out; an empty key has its marks alone.
    """
    known = words.select(F.col(column).alias("key")).filter("key IS NOT NULL").distinct()
    marked = F.concat(F.lit(START), "key", F.lit(END))
    runs = F.array_distinct(F.concat(*[_grams(marked, n) for n in range(1, GRAM + 1)]))
    return known.select(F.explode(runs).alias("gram"), "key")


def write_postings(index: DataFrame, path: str, files: int) -> None:
    """gram, holders and key in order of grams, so that one gram is read from few row groups; holders counts a gram's keys."""
    sized = index.join(gram_sizes(index), "gram")
    sized.repartitionByRange(files, "gram", "key").sortWithinPartitions("gram", "key").select("gram", "holders", "key").write.mode("overwrite").parquet(path)


def gram_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))


def _hidden(pattern: Column) -> Column:
    """The pattern with stand-ins for characters behind a backslash that are no wildcards then."""
    for plain in ("\\", "*", "?"):
        pattern = F.replace(pattern, F.lit("\\" + plain), F.lit(_ESCAPED[plain]))
    return pattern


def _shown(text: Column) -> Column:
    return F.translate(text, "".join(_ESCAPED.values()), "".join(_ESCAPED))


def needed_grams(pattern: Column) -> Column:
    """Grams that every key has which the pattern matches: of each literal part those of GRAM characters, or the part itself if it is shorter."""
    parts = F.filter(F.split(F.concat(F.lit(START), _hidden(pattern), F.lit(END)), "[*?]"), lambda p: F.length(p) > 0)
    return F.array_distinct(F.flatten(F.transform(F.transform(parts, _shown), lambda p: F.when(F.length(p) >= GRAM, _grams(p, GRAM)).otherwise(F.array(p)))))


def like_pattern(pattern: Column) -> Column:
    """The same pattern for LIKE: * is any text, ? one character, and a backslash takes its meaning away from either."""
    hidden = _hidden(pattern)
    hidden = F.regexp_replace(hidden, r"([%_\\])", r"\\$1")
    hidden = F.translate(hidden, "*?", "%_")
    return F.replace(F.translate(hidden, _ESCAPED["*"] + _ESCAPED["?"], "*?"), F.lit(_ESCAPED["\\"]), F.lit("\\\\"))


def wildcard_matches(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """(pattern, key): every key that a pattern matches as a whole, each pair once.

    Of the grams that a pattern needs, the keys of the rarest are looked at and compared with the pattern. A gram that no key has
    ends the search. The marks of the ends are grams too, so a pattern of wildcards alone meets every key, which it matches
    if that is long enough. Null patterns match nothing; an empty one matches the empty key.
    """
    asked = patterns.select("pattern").filter("pattern IS NOT NULL").distinct()
    grams = _stored(asked.select("pattern", F.explode(needed_grams(F.col("pattern"))).alias("gram")))
    sizes = _stored(gram_sizes(index.join(_asking(_stored(grams.select("gram").distinct())), "gram", "left_semi")))
    sized = grams.join(sizes, "gram", "left")
    rarest = sized.groupBy("pattern").agg(F.min(F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "gram")).alias("r")).filter("r.holders > 0")
    rarest = _stored(rarest.select("pattern", "r.gram", like_pattern(F.col("pattern")).alias("wanted")))
    met = index.join(_asking(rarest), "gram")
    return met.filter(F.expr("key LIKE wanted")).select("pattern", "key")


def wildcard_lookup(postings: DataFrame, pattern: str) -> DataFrame:
    """(key) for one pattern, from what write_postings wrote: two filters on gram, which reach the Parquet scan."""
    spark = postings.sparkSession
    one = spark.range(1).select(F.lit(pattern).alias("p")).select(needed_grams(F.col("p")).alias("grams"), like_pattern(F.col("p")).alias("wanted")).first()
    # One row for each gram of the pattern.
    sizes = {r.gram: r.holders for r in postings.filter(F.col("gram").isin(one.grams)).groupBy("gram").agg(F.max("holders").alias("holders")).collect()}
    rarest = min(one.grams, key=lambda g: (sizes.get(g, 0), g))
    return postings.filter(F.col("gram") == rarest).filter(F.col("key").like(one.wanted)).select("key")


# --- sound --------------------------------------------------------------------------------------


def rhyme_part(phones: Column) -> Column:
    """The phones from the last stressed vowel on (or the last vowel, or all), without marks of stress; phones are parted by blanks."""
    listed = F.split(F.trim(phones), " +")
    place = lambda marks: F.array_max(F.transform(listed, lambda p, i: F.when(p.rlike(f"[{marks}]$"), i)))
    start = F.coalesce(place("12"), place("0"), F.lit(0))
    return F.array_join(F.transform(F.slice(listed, start + 1, F.size(listed)), lambda p: F.regexp_replace(p, "[0-9]$", "")), " ")


def rhymes(sounds: DataFrame) -> DataFrame:
    """(word, rhyme, others): words (word, phones) with the same rhyming part, and how many other words have it; rhymes by which a word stands alone are left out.

    Words are listed with their class, not with each other, so a common rhyme makes no pairs.
    """
    keyed = sounds.filter(F.length(F.trim("phones")) > 0).select("word", rhyme_part(F.col("phones")).alias("rhyme")).distinct()
    sizes = keyed.groupBy("rhyme").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    return keyed.join(sizes, "rhyme").select("word", "rhyme", "others")


# Phones that are easily taken for each other; a phone in none of these is a class of its own.
ALIKE = (
    ("P", "B"), ("T", "D"), ("K", "G"), ("F", "V"), ("TH", "DH"), ("S", "Z"), ("SH", "ZH"), ("CH", "JH"), ("M", "N", "NG"), ("L", "R"), ("W", "Y"), ("HH",),
    ("IY", "IH", "EH", "AE"), ("AA", "AO", "OW"), ("AH", "ER", "UH", "UW"), ("EY", "AY", "OY", "AW"),
)
_CLASSES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHONES = "abcdefghijklmnopqrstuvwxyz0123456789!#$"


def phone_codes() -> dict[str, str]:
    """Two characters for each phone: its class and itself. So edits of codes are edits of phones: to take a phone for one that is alike costs 1, for any other 2, and one more or less costs 2."""
    listed = [(c, p) for c, phones in zip(_CLASSES, ALIKE, strict=False) for p in phones]
    return {p: c + own for (c, p), own in zip(listed, _PHONES, strict=True)}


def _coded(phones: Column) -> Column:
    """The codes of phones that are parted by blanks, whatever their stress; unknown phones are skipped."""
    codes = F.create_map(*[F.lit(x) for pair in phone_codes().items() for x in pair])
    listed = F.transform(F.split(F.trim(phones), " +"), lambda p: F.try_element_at(codes, F.regexp_replace(p, "[0-9]$", "")))
    return F.array_join(F.array_compact(listed), "")


def sound_alikes(queries: DataFrame, sounds: DataFrame, cost: int = 2) -> DataFrame:
    """(query, word, cost): words (word, phones) that sound like a query (query, phones): their phones can be made alike at this cost at most, see phone_codes.

    Words meet by the classes of their phones, as for typing errors, since phones of one class cost nothing there and all other edits two;
    then codes are compared exactly. Different pronunciations of a word count with the least cost. Words without known phones match nothing. Words of the
    same sound are compared once, and only the pairs that are found are spelt out. Codes are written, else a filter on them would be moved below
    whatever makes the rows different, and phones coded as often as words occur. Words that are too long or too short for all queries are not indexed.
    """
    asked = _stored(queries.select("query", _coded(F.col("phones")).alias("a"))).filter("a <> ''").distinct()
    known = _stored(sounds.select("word", _coded(F.col("phones")).alias("b"))).filter("b <> ''")
    lengths = asked.select(F.explode(F.sequence(F.length("a") - cost, F.length("a") + cost)).alias("length")).distinct()
    known = known.join(lengths, F.length("b") == F.col("length"), "left_semi").distinct()
    classes = lambda c: F.regexp_replace(c, "[^A-Z]", "")
    left, right = asked.select("a", classes(F.col("a")).alias("query")).distinct(), known.select("b", classes(F.col("b")).alias("key")).distinct()
    near = typo_matches(left, typo_index(right, "key", cost // 2), distance=cost // 2)
    pairs = near.join(left, "query").select("a", "word").join(right.withColumnRenamed("key", "word"), "word").select("a", "b")
    close = pairs.withColumn("cost", F.levenshtein("a", "b", cost)).filter(F.col("cost") >= 0)
    return close.join(asked, "a").join(known, "b").groupBy("query", "word").agg(F.min("cost").alias("cost"))
