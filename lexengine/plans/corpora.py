"""Registered queries over raw corpora as they really are, imports of whole entries, and merged entries row by row, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.functions import text
from lexengine.operators import classify, combine, mutate
from lexengine.plans import adapters
from lexengine.plans.adapters import table
from lexengine.plans.registered import query
from lexengine.plans.sql import _ENTRIES, _letters
from lexengine.session import scratch_dir
from lexengine.sources import cmudict, records, wiktionary, wordnet

_W = _letters("p_partkey")


@query(f"""WITH p AS (SELECT *, CASE WHEN p_size < 10 THEN {_W} || '-x two' ELSE {_W} END AS word FROM part WHERE p_size >= 8)
SELECT word, CASE WHEN p_size > 40 THEN 'adjective:Second ' || p_name || '.:;' ELSE '' END || 'noun:(rare) A ' || p_name || ' of ' || p_type || '.:Said ' || p_brand || ' once.;verb:To ' || p_name || ' & go.:;verb:Cut:' AS definitions FROM p""")
def messy_wiktionary(spark: SparkSession, d: str) -> DataFrame:
    """C12 with X9, X10, A12 and F11: titles that are no words, titles that differ in case, quotations and templates over several lines."""
    found = wiktionary.parse(adapters.messy_pages(spark, d))
    said = F.transform("definitions", lambda x: F.concat(x.pos, F.lit(":"), x.definition_en, F.lit(":"), F.array_join(F.transform(x.examples, lambda e: e.en), "/")))
    return found.select("word", F.array_join(said, ";").alias("definitions"))


@query(f"""SELECT {_W} || CASE WHEN p_size < 25 THEN '''-x' ELSE '' END AS word, CASE WHEN p_size < 25 THEN 'D AO1 G XX' ELSE 'K  AE1 T' END AS pronunciation, CASE WHEN p_size < 25 THEN '/dˈɔɡ/' ELSE '/kˈæt/' END AS ipa FROM part WHERE p_size >= 20""")
def messy_cmudict(spark: SparkSession, d: str) -> DataFrame:
    """C13 with F12: comments, blank lines, words without phones, spellings that are none, unknown phones."""
    return cmudict.parse(adapters.messy_lines(spark, d))


@query(f"""WITH ls AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS w FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 20)
SELECT {_letters("a.w")} AS word, count(DISTINCT b.w) - 1 AS others, coalesce(min(CASE WHEN b.w <> a.w THEN {_letters("b.w")} END), '') AS first FROM ls a JOIN ls b ON a.o = b.o GROUP BY a.w""")
def messy_wordnet(spark: SparkSession, d: str) -> DataFrame:
    """C14 with X5: members of several words, parted by underscores, take no part; capitals do not count."""
    found = wordnet.synonyms(wordnet.synset_words(adapters.messy_synsets(spark, d)))
    return found.select("word", F.size("synonyms").cast("long").alias("others"), F.coalesce(F.array_min("synonyms"), F.lit("")).alias("first"))


def _merged(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    path = scratch_dir(spark)
    records.write_json(adapters.merged_entries(spark, d), path)
    return combine.normalize(records.read_json(spark, path))


@query(f"""WITH {_ENTRIES}, e AS (SELECT entries.*, p_name, p_type, p_brand FROM entries JOIN part ON p_partkey = k)
SELECT 'words' AS name, word, p_size * 200 AS a, CASE WHEN definitions = 2 THEN 'noun,verb' ELSE '' END AS b FROM e
UNION ALL SELECT 'definitions', word, 1, 'noun:A thing of ' || p_type || '.:' || CASE WHEN p_size <= 25 THEN 'intermediate' ELSE 'advanced' END FROM e WHERE definitions = 2
UNION ALL SELECT 'definitions', word, 2, 'verb:To ' || p_name || '.:' || CASE WHEN p_size <= 25 THEN 'intermediate' ELSE 'advanced' END FROM e WHERE definitions = 2
UNION ALL SELECT 'examples', word, 1, 'An example of ' || p_brand || '.' FROM e WHERE definitions = 2
UNION ALL SELECT 'pronunciations', word, 0, CASE WHEN p_size > 25 THEN 'UK:/a/' ELSE 'US:/a/' END FROM e WHERE definitions = 2
UNION ALL SELECT 'pronunciations', word, 0, 'US:' || CASE WHEN p_size IN (7) OR p_size % 3 = 1 THEN '/dˈɔɡ/' WHEN p_size % 3 = 0 THEN '/kˈæt/' ELSE '/hʌlˈoʊ/' END FROM e WHERE definitions = 0 OR p_size > 25
UNION ALL SELECT 'word_forms', word, 0, 'plural:' || word || 's' FROM e WHERE p_size = 3""")
def normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the tables that merged entries make, found through their keys."""
    t = _merged(spark, d)
    words, zero = t["words"].select(F.col("id").alias("word_id"), "word"), F.lit(0)
    join = lambda name: t[name].join(words, "word_id")
    defs = join("definitions").withColumnRenamed("id", "definition_id")
    row = lambda df, name, a, *b: df.select(F.lit(name).alias("name"), "word", a.cast("int").alias("a"), F.concat_ws(":", *b).alias("b"))
    parts = [
        t["words"].select(F.lit("words").alias("name"), "word", F.col("frequency_rank").cast("int").alias("a"), F.array_join("part_of_speech", ",").alias("b")),
        row(defs, "definitions", F.col("definition_order"), "part_of_speech", "definition_en", "level"),
        row(t["examples"].join(defs, "definition_id"), "examples", F.col("definition_order"), "example_en"),
        row(join("pronunciations"), "pronunciations", zero, "accent", "ipa"),
        row(join("word_forms"), "word_forms", zero, "form_type", "form_word"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


@query("""SELECT 'words' AS name, c_custkey AS word_id, c_name AS what FROM customer
UNION ALL SELECT 'definitions', o_custkey, o_orderstatus || ':' || o_orderpriority FROM orders UNION ALL SELECT 'definitions', 7, unnest(['noun:a buyer', 'verb:to buy'])
UNION ALL SELECT 'examples', o_custkey, l_returnflag || ' ' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'examples', 7, 'It is a buyer.'
UNION ALL SELECT 'pronunciations', o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'US' ELSE 'UK' END || ':/' || o_orderpriority || '/' FROM orders
UNION ALL SELECT 'pronunciations', 7, accent || ':/new/' FROM (SELECT unnest(['US', 'UK', 'AU']) AS accent) WHERE accent NOT IN (SELECT CASE WHEN o_orderstatus = 'F' THEN 'US' ELSE 'UK' END FROM orders WHERE o_custkey = 7)
UNION ALL SELECT 'synonyms', s_suppkey, s_name FROM supplier UNION ALL SELECT 'synonyms', 7, 'client'
UNION ALL SELECT 'word_forms', user_id, event_type || ':' || event_id FROM events
UNION ALL SELECT 'word_forms', 7, f || ':new' FROM (SELECT unnest(['plural', 'click']) AS f) WHERE f NOT IN (SELECT event_type FROM events WHERE user_id = 7)""")
def import_whole_entry(spark: SparkSession, d: str) -> DataFrame:
    """One entry with all its children imported into the tables; all rows afterwards."""
    entry = {
        "word": "Customer#000000007", "language": "en", "definitions": [("noun", "a buyer", None, [("It is a buyer.", None)]), ("verb", "to buy", None, [])],
        "pronunciations": [("US", "/new/"), ("UK", "/new/"), ("AU", "/new/")], "synonyms": ["client", "Supplier#000000007"], "word_forms": {"plural": "new", "click": "new"},
    }
    words = adapters.words(spark, d).select("id", "word")
    new = combine.normalize(records.from_request(spark, entry))
    # The word is there already, so the entry's children go to its key.
    own = words.join(new["words"].select("word", F.col("id").alias("word_id")), "word").select("word_id", F.col("id").alias("known"))
    keyed = lambda df: df.join(own, "word_id", "left").withColumn("word_id", F.coalesce("known", "word_id")).drop("known")
    columns = {"words": ["id", "word"], "definitions": ["id", "word_id", "part_of_speech", "definition_en"], "examples": ["id", "definition_id", "example_en"], "pronunciations": ["word_id", "accent", "ipa"], "synonyms": ["word_id", "synonym_word"], "word_forms": ["word_id", "form_type", "form_word"]}
    there = {"words": words, "definitions": adapters.word_definitions(spark, d), "examples": adapters.word_examples(spark, d), "pronunciations": adapters.word_pronunciations(spark, d), "synonyms": adapters.word_synonyms(spark, d), "word_forms": adapters.word_forms(spark, d)}
    there = {name: df.select(columns[name]) for name, df in there.items()}
    rows = {name: (keyed(df) if "word_id" in df.columns else df).select(columns[name]) for name, df in new.items()}
    after = mutate.import_entry(there, rows)
    defs = after["definitions"].select(F.col("id").alias("definition_id"), "word_id")
    say = lambda name, df, key, *what: df.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("word_id"), F.concat_ws(":", *what).alias("what"))
    found = say("words", after["words"], "id", "word")
    for part in (
        say("definitions", after["definitions"], "word_id", "part_of_speech", "definition_en"), say("examples", after["examples"].join(defs, "definition_id"), "word_id", "example_en"), say("pronunciations", after["pronunciations"], "word_id", "accent", "ipa"),
        say("synonyms", after["synonyms"], "word_id", "synonym_word"), say("word_forms", after["word_forms"], "word_id", "form_type", "form_word"),
    ):
        found = found.unionByName(part)
    return found


# --- rules of real size (C1, C2) ----------------------------------------------------------------


_PASSAGES = """kw AS (SELECT DISTINCT 'passage-' || item_id AS category, w AS k FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)),
lines AS (SELECT doc_id AS word, lower(unnest(string_split(text, chr(10)))) AS t FROM documents), hits AS (SELECT DISTINCT word, category, k FROM lines JOIN kw ON contains(t, k)),
mem AS (SELECT DISTINCT word, category FROM hits UNION ALL SELECT doc_id, 'others' FROM documents WHERE doc_id NOT IN (SELECT word FROM hits))"""


def _passage_words(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each benchmark passage, with its words of six plain letters or more."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    return table(spark, d, "benchmark").select(F.lit("passages").alias("topic"), F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("name"), words.alias("keyword"))


@query(f"WITH {_PASSAGES} SELECT word, category FROM mem")
def categorize_passages(spark: SparkSession, d: str) -> DataFrame:
    """C1 with rules from a table: hundreds of keywords, more with more passages."""
    return classify.categorize(None, adapters.definitions(spark, d), classify.rules_from(_passage_words(spark, d)))


@query(f"""WITH {_PASSAGES}, found AS (SELECT DISTINCT category AS parent, category || '-' || k[1] AS subcategory, word FROM hits)
SELECT * FROM found UNION ALL SELECT category, category || '-general', word FROM mem WHERE category <> 'others' AND NOT EXISTS (SELECT 1 FROM found WHERE parent = category AND found.word = mem.word)""")
def subcategorize_passages(spark: SparkSession, d: str) -> DataFrame:
    """C2 with sub-rules of their own: below each passage one for each first letter of its words."""
    rows = _passage_words(spark, d)
    rules = classify.rules_from(rows)
    subrules = classify.subrules_from(rows.select(F.col("name").alias("parent"), "topic", F.substring("keyword", 1, 1).alias("name"), "keyword"))
    return classify.classify(adapters.definitions(spark, d), rules, subrules)


# --- collation (X22) ----------------------------------------------------------------------------


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents)
SELECT min(w) AS spelling, count(DISTINCT w) AS spellings, count(*) AS n FROM w GROUP BY strip_accents(lower(replace(replace(w, 'ß', 'ss'), 'ẞ', 'ss')))""")
def collation_classes(spark: SparkSession, d: str) -> DataFrame:
    """The words of all documents that a collation takes for one, whatever their case and accents, and in how many spellings they occur."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(text.collated(F.col("w"), "UNICODE_CI_AI").alias("k")).agg(F.min("w").alias("spelling"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")).drop("k")
