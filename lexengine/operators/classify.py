"""Keyword classification into two levels of categories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

OTHERS = "others"
#: Rules per number in a set of hits.
BITS = 64


@dataclass(frozen=True)
class Rule:
    """A category and the keywords that put a word into it."""

    name: str
    topic: str
    keywords: tuple[str, ...]


def parse_rules(text: str) -> tuple[Rule, ...]:
    """Rules from lines of topic, name and keywords, separated by bars; keywords are not trimmed."""
    rows = [line.split("|") for line in text.strip().splitlines()]
    return tuple(Rule(name, topic, tuple(keywords)) for topic, name, *keywords in rows)


#: Own rules; callers bring theirs.
RULES = parse_rules("""
nature|animals|animal|bird|fish|genus |mammal
nature|plants|plant|tree|flower|leaf
nature|water|water|river|sea|ocean|then
nature|weather|rain|storm|cloud|wind
nature|earth|rock|stone|hill|mountain
nature|sky|sun|moon|star|planet
nature|matter|metal|iron|gold|salt
nature|insects|insect|bee|ant |moth
people|body|body|hand|head|thand
people|work|work|job|office|ation
people|speech|say|word|speech|ment
people|family|mother|father|child|sister
people|health|health|ill |heal|pain
people|food|food|bread|meat|eat
people|clothes|cloth|coat|shoe|dress
people|homes|house|home|door|room
people|law|law|court|judge|crime
people|war|war|army|soldier|battle
people|trade|trade|money|price|sell
people|play|play|game|sport|ball
people|music|music|song|sing|drum
people|faith|god|church|pray|saint
people|travel|road|ship|travel|train
people|learning|school|learn|teach|book
ideas|time|time|hour|day|year|heit
ideas|quantity|many|few|number|ción
ideas|space|space|place|near|far
ideas|shape|round|line|angle|square
ideas|colour|colour|red|blue|green
ideas|motion|move|run|turn|fall
ideas|thought|think|mind|idea|reason
ideas|feeling|love|fear|joy|anger
""")

#: Below a rule there is a sub-category for each of its keywords.
SUBRULES = {r.name: tuple(Rule(k.strip(), r.topic, (k,)) for k in r.keywords) for r in RULES}


def rules_from(rows: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (topic, name, keyword), in order of name and keyword; null names and null or empty keywords are left out.

    Rules are a configuration: all of them come to the driver, so that tasks get one automaton.
    """
    kept = rows.filter("name IS NOT NULL AND keyword <> ''").groupBy("name").agg(F.min("topic").alias("topic"), F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return tuple(Rule(r.name, r.topic, tuple(r.keywords)) for r in kept.orderBy("name").collect())


def subrules_from(rows: DataFrame) -> dict[str, tuple[Rule, ...]]:
    """Rules below rules from a table (parent, topic, name, keyword); names of sub-rules are their own below each parent."""
    kept = rows.filter("parent IS NOT NULL AND name IS NOT NULL AND keyword <> ''").groupBy("parent", "name").agg(F.min("topic").alias("topic"), F.array_sort(F.collect_set("keyword")).alias("keywords"))
    found: dict[str, tuple[Rule, ...]] = {}
    for r in kept.orderBy("parent", "name").collect():
        found[r.parent] = (*found.get(r.parent, ()), Rule(r.name, r.topic, tuple(r.keywords)))
    return found


def rule_automaton(rules: tuple[Rule, ...]) -> ahocorasick.Automaton | None:
    """Finds in one pass which rules' keywords a text holds; None without keywords. Values are sets of hits."""
    holders: dict[str, int] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            if k:
                holders[k.lower()] = holders.get(k.lower(), 0) | 1 << i
    if not holders:
        return None
    found = ahocorasick.Automaton()
    for k, hits in holders.items():
        found.add_word(k, hits)
    found.make_automaton()
    return found


def rule_hits(text: Column, rules: tuple[Rule, ...]) -> Column:
    """the rules with a keyword in the text, as a set of bits over BITS rules a number; case does not count.

    All keywords are found in one pass, so time does not depend on how many there are. There are no word
    boundaries, and keywords are not trimmed. A null text has no hits.
    """
    numbers = -(-len(rules) // BITS) or 1

    @F.arrow_udf(ArrayType(LongType()))
    def hits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = rule_automaton(rules)
        for part in texts:
            out = []
            for t in part.to_pylist():
                found = 0
                if machine is not None and t is not None:
                    for _, hit in machine.iter(t):
                        found |= hit
                out.append(found.to_bytes(BITS // 8 * numbers, "little"))
            yield pa.ListArray.from_arrays(np.arange(0, numbers * len(part) + 1, numbers, dtype=np.int32), np.frombuffer(b"".join(out), "<i8"))

    return hits(F.lower(text))


def word_hits(definitions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(word, hits): the rules that any definition of the word fulfils, in one scan; sets are united before the shuffle."""
    numbers = -(-len(rules) // BITS) or 1
    found = definitions.select("word", rule_hits(F.col("definition_en"), rules).alias("h"))
    united = [F.bit_or(F.col("h")[i]).alias(f"h{i}") for i in range(numbers)]
    return found.groupBy("word").agg(*united).select("word", F.array(*[f"h{i}" for i in range(numbers)]).alias("hits"))


def _names(hits: Column, rules: tuple[Rule, ...], chosen: range) -> Column:
    """The names of the chosen rules that are in a set of hits; one expression, however many rules there are."""
    if not chosen:
        return F.array().cast("array<string>")
    names = F.array(*[F.lit(rules[i].name) for i in chosen])

    def hit(name: Column, i: Column) -> Column:
        at = i + chosen.start
        return F.getbit(F.get(hits, ((at - at % BITS) / BITS).cast("int")), at % BITS) == 1

    return F.filter(names, hit)


def matches(definitions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Distinct (word, category) of words with a definition that holds a keyword of the rule."""
    found = word_hits(definitions, rules)
    return found.select("word", F.explode(_names(F.col("hits"), rules, range(len(rules)))).alias("category")).distinct()


def _or_others(names: Column) -> Column:
    return F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(OTHERS)))).alias("category")


def categorize(words: DataFrame | None, definitions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(word, category); words without any category are in `others`.

    Without words, those of the definitions count, and one scan is enough; a null definition is no hit.
    """
    if words is not None:
        definitions = definitions.select("word", "definition_en").unionByName(words.select("word", F.lit(None).cast("string").alias("definition_en")))
    return word_hits(definitions, rules).select("word", _or_others(_names(F.col("hits"), rules, range(len(rules)))))


def subcategorize(members: DataFrame, definitions: DataFrame, subrules: dict[str, tuple[Rule, ...]] = SUBRULES) -> DataFrame:
    """(parent, subcategory, word) for the parents with rules.

    A sub-category is the part of the parent's words that its rule matches, and is named after
    both; words of the parent that none matches are in <parent>-general.
    """
    flat = tuple(Rule(f"{p}-{r.name}", p, r.keywords) for p, rules in subrules.items() for r in rules)
    own = members.filter(F.col("category").isin(list(subrules))).groupBy("word").agg(F.collect_set("category").alias("parents"))
    return _placed(own.join(word_hits(definitions, flat), "word", "left"), flat, 0, subrules)


def classify(definitions: DataFrame, rules: tuple[Rule, ...] = RULES, subrules: dict[str, tuple[Rule, ...]] = SUBRULES) -> DataFrame:
    """C1 and C2 in one scan: (parent, subcategory, word) of all words of the definitions that are in a category with sub-rules."""
    flat = tuple(Rule(f"{p}-{r.name}", p, r.keywords) for p, own in subrules.items() for r in own)
    found = word_hits(definitions, rules + flat)
    return _placed(found.withColumn("parents", _names(F.col("hits"), rules, range(len(rules)))), flat, len(rules), subrules)


def _placed(found: DataFrame, flat: tuple[Rule, ...], before: int, subrules: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """The sub-categories of words (word, parents, hits); the rules in flat begin at the place `before` among the hits."""
    if not subrules:
        return found.select(F.lit("").alias("parent"), F.lit("").alias("subcategory"), "word").limit(0)
    found = found.select("word", F.explode(_under("parents", "hits", flat, before, tuple(subrules))).alias("s"))
    return found.select("s.parent", "s.subcategory", "word")


def _under(parents: str, hits: str, flat: tuple[Rule, ...], before: int, known: tuple[str, ...]) -> Column:
    """(parent, subcategory) for each parent of a word: of the rules that it hits, or else <parent>-general. Only rules that are hit are looked at, however many there are."""
    own = frozenset(known)

    @F.arrow_udf("array<struct<parent:string,subcategory:string>>")
    def places(words: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, sets in words:
            out = []
            for there, numbers in zip(names.to_pylist(), sets.to_pylist(), strict=True):
                below: dict[str, list[str]] = {p: [] for p in there or () if p in own}
                left = int.from_bytes(np.array(numbers or [], "<i8").tobytes(), "little") >> before if below else 0
                while left:
                    rule = flat[(left & -left).bit_length() - 1]
                    left &= left - 1
                    if rule.topic in below:
                        below[rule.topic].append(rule.name)
                out.append([{"parent": p, "subcategory": s} for p, subs in below.items() for s in subs or [f"{p}-general"]])
            yield pa.array(out, pa.list_(pa.struct([("parent", pa.string()), ("subcategory", pa.string())])))

    return places(F.col(parents), F.col(hits))


def rule_orders(parent: str, rules: tuple[Rule, ...], kept: set[str]) -> dict[str, int]:
    """Q16: display orders of the sub-categories; one that is dropped as empty leaves its number unused."""
    return {f"{parent}-{r.name}": i for i, r in enumerate(rules, 1) if f"{parent}-{r.name}" in kept}


def summary(members: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Words per category, categories without words too; rules are few, so they are broadcast."""
    spark = members.sparkSession
    names = spark.createDataFrame([(r.name, r.topic) for r in rules] + [(OTHERS, "other")], "category string, topic string")
    counts = members.groupBy("category").agg(F.count("word").alias("word_count"))
    return names.join(counts, "category", "left").select("category", "topic", F.coalesce("word_count", F.lit(0).cast("long")).alias("word_count"))


def in_several(members: DataFrame) -> DataFrame:
    """Words in more than one category."""
    return members.groupBy("word").agg(F.count(F.lit(1)).alias("categories")).filter("categories > 1")


def uncategorized(words: DataFrame, members: DataFrame) -> DataFrame:
    """Words without any category; null keys on the members' side match nothing."""
    return words.join(members.select("word"), "word", "left_anti")
