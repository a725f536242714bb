"""The driver's tables as tables of a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.operators import combine
from lexengine.session import scratch_dir
from lexengine.sources import cmudict, wiktionary, wordnet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as words; a negative balance is a missing rank."""
    rank = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("word"), F.lower("c_name").alias("word_normalized"), rank.alias("frequency_rank"), F.col("c_nationkey").alias("category_id"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as categories with their region as topic, and regions as the parents (ids from 1000 on)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    child = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.initcap("n_name").alias("display_name"), F.col("r_name").alias("topic"), (F.col("n_regionkey") + 1000).alias("parent_id"), (F.col("n_nationkey") % 7).cast("int").alias("display_order")
    )
    parent = region.select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.initcap("r_name").alias("display_name"), F.col("r_name").alias("topic"), F.lit(None).cast("int").alias("parent_id"), F.lit(None).cast("int").alias("display_order"))
    return child.unionByName(parent)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of their nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("category_id"), F.col("c_custkey").alias("word_id"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as words whose definitions are their lines; a null text is a word with a null definition."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("word"), F.explode_outer(F.split("text", "\n")).alias("definition_en"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("word"))


def synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as synsets of their parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("synset"), F.col("l_partkey").alias("word")).distinct()


# --- children of words --------------------------------------------------------------------------


def word_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as definitions of their customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("word_id"), F.col("o_orderstatus").alias("part_of_speech"), F.col("o_orderpriority").alias("definition_en"),
        F.lit(None).cast("string").alias("definition_vi"), F.lit(None).cast("string").alias("level"), (F.col("o_orderkey") % 3).cast("int").alias("definition_order"),
    )


def word_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as examples of their order; those that came back have a translation."""
    lines = table(spark, sf_dir, "lineitem")
    text = F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string"))
    return lines.select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("definition_id"), text.alias("example_en"), F.when(F.col("l_returnflag") == "R", text).alias("example_vi"))


def word_pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pronunciations of their customer, in US accent if finished."""
    orders = table(spark, sf_dir, "orders")
    accent = F.when(F.col("o_orderstatus") == "F", "US").otherwise("UK")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("word_id"), accent.alias("accent"), F.concat(F.lit("/"), "o_orderpriority", F.lit("/")).alias("ipa"), F.lit(None).cast("string").alias("audio_url"))


def word_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as synonyms of the customer of the same number."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("word_id"), F.col("s_name").alias("synonym_word"))


def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as forms of the customer of the user's number."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("word_id"), F.col("event_type").alias("form_type"), F.col("event_id").cast("string").alias("form_word"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings of a user's word; three kinds of event tell an accent."""
    kind = F.col("event_type")
    end = F.when(kind == "view", "-us.mp3").when(kind == "click", "-uk.mp3").when(kind == "purchase", "/uk/x.mp3").otherwise(".mp3")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("word"), F.col("event_id").alias("seq"), F.concat(F.lit("http://x/"), F.col("event_id").cast("string"), end).alias("url"))


# --- raw corpora, written as files and read by the sources ----------------------------------------


def letters(c: Column) -> Column:
    """A number as a word."""
    return F.concat(F.lit("w"), F.translate(c.cast("string"), "0123456789", "abcdefghij"))


def wiktionary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of an XML dump; small parts have no English section."""
    english = F.concat(
        F.lit("==English==\n{{IPA|en|/a/|"), F.when(F.col("p_size") > 25, "UK").otherwise("US"), F.lit("}}\n===Noun===\n# A [["), "p_name", F.lit("|thing]] of "), "p_type",
        F.lit(".\n#: {{ux|en|An example of "), "p_brand", F.lit(".}}\n====Verb====\n# To "), "p_name", F.lit(".\n==French==\n===Noun===\n# Autre"),
    )
    text = F.when(F.col("p_size") >= 10, english).otherwise("==French==\n===Noun===\n# Autre")
    pages = table(spark, sf_dir, "part").select(F.upper(letters(F.col("p_partkey"))).alias("title"), F.struct(F.struct(text.alias("_VALUE"), F.length(text).cast("long").alias("_bytes")).alias("text")).alias("revision"))
    path = scratch_dir(spark)
    pages.write.format("xml").option("rootTag", "dump").option("rowTag", "page").save(path)
    return wiktionary.read_pages(spark, path)


def messy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with what real ones have: other name spaces, titles of several words or that differ in case, templates over several lines, quotations."""
    part, word, size = table(spark, sf_dir, "part"), letters(F.col("p_partkey")), F.col("p_size")
    title = F.when(size < 5, F.concat(F.lit("Category:"), word)).when(size < 8, F.concat(word, F.lit(" two"))).when(size < 10, F.concat(word, F.lit("-x two"))).otherwise(word)
    text = F.concat(
        F.lit("{{also|x}}\n==English==\n===Etymology===\n# no sense\n===Noun===\n# {{lb|en|rare}} A [[x|"), "p_name", F.lit("]] {{gloss|of\n"), "p_type",
        F.lit("}}.\n#: no example\n#* {{quote-book|en|title=T\n|passage=Said {{w|page|"), "p_brand", F.lit("}} once.\n|page=3}}\n## It\n===Proper noun===\n# no header\n====Verb====\n# To {{w|"), "p_name",
        F.lit("}} &amp; {{x|{{y}}}}go.\n# Cut {{quote-web|text=never closed\n==French==\n===Noun===\n# Autre"),
    )
    again = part.filter("p_size > 40").select(F.upper(word).alias("title"), F.concat(F.lit("==English==\n===Adjective===\n# Second "), "p_name", F.lit(".")).alias("text"))
    return part.select(title.alias("title"), text.alias("text")).unionByName(again)


def messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a pronouncing dictionary, some of them comments, blank, without phones or misspelt."""
    word, size = F.upper(letters(F.col("p_partkey"))), F.col("p_size")
    line = F.when(size < 5, F.concat(F.lit(";;; "), word)).when(size < 8, "  ").when(size < 10, word).when(size < 15, F.concat(word, F.lit(".2  K AE1 T"))).when(size < 20, F.concat(F.lower(word), F.lit("(2)  K AE1 T")))
    line = line.when(size < 25, F.concat(word, F.lit("'-X  D AO1 G XX"))).otherwise(F.concat(word, F.lit("  K  AE1 T ")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), line.alias("value"))


def messy_synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of synsets of their parts; small parts have names of several words, parted by underscores."""
    parts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_partkey", "p_size").distinct()
    name = F.when(F.col("p_size") < 20, F.concat(F.lit("true_"), letters(F.col("p_partkey")))).otherwise(F.initcap(letters(F.col("p_partkey"))))
    sets = parts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(name)).alias("w"))
    line = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit(" 02 n "), F.lpad(F.lower(F.hex(F.size("w"))), 2, "0"), F.lit(" "), F.array_join("w", " 0 "), F.lit(" 0 000 | a_gloss"))
    return sets.select(F.lit("noun").alias("pos"), F.col("l_orderkey").alias("line"), line.alias("value"))


def cmudict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a pronouncing dictionary: some twice, some as a variant alone."""
    part = table(spark, sf_dir, "part")
    word, size = F.upper(letters(F.col("p_partkey"))), F.col("p_size")
    phones = F.when(size % 3 == 0, "K AE1 T").when(size % 3 == 1, "D AO1 G").otherwise("HH AH0 L OW1")
    first = part.select(F.lit(0).alias("turn"), "p_partkey", F.concat(word, F.when(size == 25, "(1)").otherwise(""), F.lit("  "), phones).alias("value"))
    again = part.filter("p_size IN (7, 25)").select(F.lit(1).alias("turn"), "p_partkey", F.concat(word, F.when(size == 25, "(2)").otherwise(""), F.lit("  D AO1 G")).alias("value"))
    path = scratch_dir(spark)
    rows = first.unionByName(again).repartitionByRange("turn", "p_partkey").sortWithinPartitions("turn", "p_partkey")
    rows.select("value").write.text(path)
    return cmudict.read_lines(spark, path)


def wordnet_files(spark: SparkSession, sf_dir: str) -> str:
    """Orders as noun synsets of their parts, and plurals of the parts of one size; the folder."""
    path = scratch_dir(spark)
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("synset")).agg(F.sort_array(F.collect_set(letters(F.col("l_partkey")))).alias("w"))
    count = F.lpad(F.lower(F.hex(F.size("w"))), 2, "0")
    line = F.concat(F.lpad(F.col("synset").cast("string"), 8, "0"), F.lit(" 02 n "), count, F.lit(" "), F.array_join("w", " 0 "), F.lit(" 0 000 | gloss"))
    sets.select(line.alias("value")).write.text(f"{path}/data.noun")
    word = letters(F.col("p_partkey"))
    table(spark, sf_dir, "part").filter("p_size = 3").select(F.concat(word, F.lit("s "), word).alias("value")).write.text(f"{path}/noun.exc")
    return path


def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three corpora parsed and merged by word; a part's size gives its rank."""
    folder = wordnet_files(spark, sf_dir)
    ranks = table(spark, sf_dir, "part").select(letters(F.col("p_partkey")).alias("word"), (F.col("p_size") * 200).alias("frequency_rank"))
    net = wordnet.parse(wordnet.read_synsets(spark, folder), wordnet.read_exceptions(spark, folder))
    return combine.combine(wiktionary.parse(wiktionary_pages(spark, sf_dir)), cmudict.parse(cmudict_lines(spark, sf_dir)), net, ranks)
