"""The registered queries: operators of the lexicon over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexengine.functions import checks, text
from lexengine.operators import catalog, classify, combine, extern, lookup, mutate, quality, search
from lexengine.plans import adapters
from lexengine.plans.adapters import table
from lexengine.session import scratch_dir
from lexengine.sources import cmudict, records, wiktionary, wordnet

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- categories ---------------------------------------------------------------------------------


@query
def topic_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.topic_list(adapters.categories(spark, d))


@query
def category_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.category_list(adapters.categories(spark, d), adapters.members(spark, d))


@query
def category_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    return catalog.category_list(adapters.categories(spark, d), adapters.members(spark, d), topic="ASIA", parent_only=True)


@query
def subcategory_counts(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("category_id"), F.col("c_custkey").alias("word_id"))
    return catalog.subcategories(adapters.categories(spark, d), few, 1002)


@query
def category_page(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.words(spark, d).filter("category_id = 3").select("id", "word", "frequency_rank")
    return catalog.page(rows, [F.col("frequency_rank").asc_nulls_last(), "word", "id"], 2, 10)


@query
def category_page_meta(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page_meta(adapters.words(spark, d).filter("category_id = 3"), 2, 10)


@query
def category_search_ilike(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(table(spark, d, "part"), "p_name", "RE").select("p_partkey", "p_name")


@query
def tree_detail(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tree_detail(adapters.categories(spark, d), adapters.members(spark, d))


@query
def subcategory_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.subcategory_summary(adapters.categories(spark, d), adapters.members(spark, d))


@query
def semi_join_children(spark: SparkSession, d: str) -> DataFrame:
    children = adapters.categories(spark, d).filter("parent_id = 1001")
    return adapters.members(spark, d).join(children.select(F.col("id").alias("category_id")), "category_id", "left_semi")


# --- search -------------------------------------------------------------------------------------


def _customer_index(spark: SparkSession, d: str) -> DataFrame:
    return search.key_index(adapters.words(spark, d))


@query
def word_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return search.autocomplete(_customer_index(spark, d), " Customer#00000 ", 15).select("id", "word", F.coalesce("frequency_rank", F.lit(-1)).alias("frequency_rank"))


@query
def word_autocomplete_ranked(spark: SparkSession, d: str) -> DataFrame:
    return search.autocomplete(_customer_index(spark, d), "customer#", 15, rank_first=True).select("id", "word", "frequency_rank")


@query
def category_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    counts = catalog.category_list(adapters.categories(spark, d), adapters.members(spark, d)).select("id", "word_count")
    return search.category_autocomplete(adapters.categories(spark, d).join(counts, "id"), "nation_1", 5)


@query
def topic_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return search.topic_autocomplete(adapters.categories(spark, d), "a", 8)


@query
def user_list_prefix(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").cast("string").alias("word"))
    return search.user_words(lists, 7, "1")


@query
def exact_key(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_word(adapters.words(spark, d), "customer#000000042").select("id", "word")


@query
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _customer_index(spark, d).agg(F.countDistinct("key").alias("distinct_keys"), F.count(F.lit(1)).alias("entries"))


# --- classification -----------------------------------------------------------------------------


def _members(spark: SparkSession, d: str) -> DataFrame:
    return classify.categorize(None, adapters.definitions(spark, d))


@query
def categorize(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d)


@query
def categorize_others(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).filter(F.col("category") == classify.OTHERS).select("word")


@query
def categorize_summary(spark: SparkSession, d: str) -> DataFrame:
    return classify.summary(_members(spark, d))


@query
def multi_category_words(spark: SparkSession, d: str) -> DataFrame:
    return classify.in_several(_members(spark, d))


@query
def uncategorized_check(spark: SparkSession, d: str) -> DataFrame:
    return classify.uncategorized(adapters.document_words(spark, d), _members(spark, d)).agg(F.count(F.lit(1)).alias("uncategorized"))


@query
def categorized_words(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).agg(F.countDistinct("word").alias("words"), F.count(F.lit(1)).alias("memberships"))


@query
def subcategorize(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(adapters.definitions(spark, d))


@query
def subcategorize_members(spark: SparkSession, d: str) -> DataFrame:
    """C2 over memberships that are there already."""
    chosen = {p: classify.SUBRULES[p] for p in ("water", "time")}
    return classify.subcategorize(_members(spark, d), adapters.definitions(spark, d), chosen)


# --- sources ------------------------------------------------------------------------------------


@query
def synonyms_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct partners of each word over its synsets."""
    sets = adapters.synsets(spark, d).groupBy("synset").agg(F.collect_list(F.col("word").cast("string")).alias("words"))
    found = wordnet.synonyms(sets.select(F.lit("noun").alias("pos"), F.col("synset").alias("line"), "words"))
    return found.select(F.col("word").cast("long").alias("word"), F.size("synonyms").cast("long").alias("synonyms")).filter("synonyms > 0")


@query
def synonym_top10(spark: SparkSession, d: str) -> DataFrame:
    by_word = adapters.synsets(spark, d).groupBy("synset").agg(F.slice(F.array_sort(F.collect_set("word")), 1, 10).alias("w"))
    return by_word.select("synset", F.size("w").cast("long").alias("n"), F.array_min("w").alias("first"), F.array_max("w").alias("last"))


@query
def word_forms_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return lookup.last_wins(rows, ["user_id"], "event_type", "value", ["ts", "event_id"])


@query
def accent_pick(spark: SparkSession, d: str) -> DataFrame:
    return lookup.first_match(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query
def merge_three_sources(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    rich = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    base = adapters.words(spark, d)
    found = base.join(orders, base.id == orders.o_custkey, "left").join(rich, base.id == rich.s_suppkey, "left")
    return found.select("id", "word", F.coalesce("orders", F.lit(-1).cast("long")).alias("orders"), F.col("s_acctbal").alias("balance"))


@query
def backfill_missing(spark: SparkSession, d: str) -> DataFrame:
    poor = table(spark, d, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("id"))
    useful = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders")).filter("orders > 5")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(poor, "id", "left_anti").join(useful, "id")


@query
def level_classifier(spark: SparkSession, d: str) -> DataFrame:
    return adapters.words(spark, d).select("id", text.level(F.col("frequency_rank"), F.substring("word", 10, 100)).alias("level"))


@query
def frequency_order(spark: SparkSession, d: str) -> DataFrame:
    return combine.in_order(adapters.words(spark, d)).select("id", "word", F.coalesce("frequency_rank", F.lit(-1)).alias("frequency_rank"))


@query
def inflection_classifier(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("form"))
    forms = tokens.groupBy("form").agg(F.count(F.lit(1)).alias("n")).select("form", "n", F.explode(F.array(*map(F.lit, wordnet.PARTS_OF_SPEECH))).alias("pos"))
    kinds = forms.select("pos", F.coalesce(text.inflection(F.col("form"), F.col("pos")), F.lit("none")).alias("kind"), "n")
    return kinds.groupBy("pos", "kind").agg(F.sum("n").alias("n"))


@query
def arpabet_ipa(spark: SparkSession, d: str) -> DataFrame:
    """The letters of a part's name, read as numbers of phones; vowels are stressed by the part's size."""
    known = list(text.ARPABET)
    phones = F.array(*[F.lit(p) for p in known])
    vowels = F.array(*[F.lit(p) for p in known if p[0] in "AEIOU"])
    one = lambda c: F.element_at(phones, F.ascii(c) % len(known) + 1)
    said = F.transform(F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), one), lambda p: F.when(F.array_contains(vowels, p), F.concat(p, (F.col("p_size") % 3).cast("string"))).otherwise(p))
    return table(spark, d, "part").select("p_partkey", text.arpabet_to_ipa(F.array_join(said, " ")).alias("ipa"))


@query
def hex_word_count(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.lpad(F.lower(F.hex("p_size")), 2, "0").alias("h"))
    return parts.select("p_partkey", wordnet.hex_count(F.col("h")).alias("words"))


@query
def title_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = text.strip_markup(text.decode_entities(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.length(clean).cast("long").alias("chars"), F.md5(clean).alias("digest"))


@query
def wikitext_clean(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("{{lb|en|rare}} [["), "p_name", F.lit("|"), "p_brand", F.lit("]] {{a|{{b}}}} {{gloss|"), "p_type", F.lit("}} '''x'''  &amp;lt;b&gt;"))
    return table(spark, d, "part").select("p_partkey", text.clean_wikitext(marked).alias("clean"))


@query
def regex_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query
def normalize_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_key(F.concat(F.lit(" \t"), "text", F.lit("\n ")))).alias("key"))


@query
def definition_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return combine.definition_order(docs, "doc_id", "lines").select("doc_id", "definition_order", F.md5("definition").alias("digest"))


@query
def language_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    return rows.select(text.language_name(F.col("lang")).alias("language"), "documents")


# --- quality ------------------------------------------------------------------------------------


@query
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, d, "documents").join(labels, "doc_id", "left")
    return quality.coverage(rows, {"label": F.col("quality").isNotNull(), "quality": F.col("quality") == 1, "long_text": F.col("n_chars") > 2000})


@query
def template_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.marker_counts(table(spark, d, "documents"), "text", ("***", "%%%", "!!", " | "))


@query
def template_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return mutate.delete_like(table(spark, d, "documents"), "text", ("***", "%%%", "!!", " | ")).select("doc_id")


@query
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = [table(spark, d, t).agg(F.count(F.lit(1)).alias(f"n_{t}")) for t in ("customer", "orders", "lineitem", "documents")]
    found = counts[0]
    for one in counts[1:]:
        found = found.crossJoin(one)  # one row each
    return found


@query
def verify_chain(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("orders"), F.sum("lines").alias("lines"))
    words = table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0).cast("long")
    return words.select("c_custkey", F.coalesce("orders", zero).alias("orders"), F.coalesce("lines", zero).alias("lines"))


@query
def missing_translation_worklist(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    rows = table(spark, d, "documents").join(labels, "doc_id", "left")
    return quality.worklist(rows, F.col("quality").isNull(), [F.desc("n_chars"), "doc_id"], 25).select("doc_id", "n_chars")


# --- lookup -------------------------------------------------------------------------------------


@query
def lookup_flat(spark: SparkSession, d: str) -> DataFrame:
    turns = lookup.nested(table(spark, d, "conversations"), "conv_id", ["turn"], ["turn", "role", "text"], "turns")
    return turns.select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_join(F.transform("turns", lambda t: t.role), ",").alias("roles"), F.md5(F.array_join(F.transform("turns", lambda t: t.text), "\n")).alias("digest"))


# --- mutations ----------------------------------------------------------------------------------


@query
def import_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders are there already; all customers come in."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    there = rows.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return mutate.insert_missing(there, rows.select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name"), ["c_name"])


@query
def add_words_outcome(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("word"), F.col("c_custkey").alias("word_id"))
    own = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("word_id"))
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("word"))
    return mutate.outcome_counts(mutate.add_outcomes(requests, words, own))


@query
def user_list_import(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    raw = F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit("  "), F.upper("event_type"), F.lit("\t")))
    requests = events.select("user_id", raw.alias("word"))
    lists = events.filter("value > 90").select("user_id", F.col("event_type").alias("word"))
    return mutate.user_import(lists, requests)


@query
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").filter("c_acctbal >= 0")
    return mutate.cascade(table(spark, d, "orders"), left, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query
def orphan_parents(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "region").filter("r_regionkey < 3")
    return mutate.orphan(table(spark, d, "nation"), left, "n_regionkey", "r_regionkey").select("n_nationkey", F.coalesce("n_regionkey", F.lit(-1)).alias("n_regionkey"))


@query
def update_notes(spark: SparkSession, d: str) -> DataFrame:
    return mutate.update_where(table(spark, d, "nation"), F.col("n_regionkey") == 2, {"n_name": F.lower("n_name")}).select("n_nationkey", "n_name")


@query
def translate_coalesce(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("vi"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left")
    return mutate.fill_missing(rows, "vi", F.concat(F.lit("from "), "lang")).select("doc_id", "vi")


# --- replies ------------------------------------------------------------------------------------


@query
def json_in_text(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))
    return table(spark, d, "events").select("event_id", F.get_json_object(text.json_in_prose(said), "$.k").alias("k"))


@query
def sentence_parse(spark: SparkSession, d: str) -> DataFrame:
    found = text.sentences(F.col("text"), 3)
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("sentences"), F.md5(F.array_join(found, "\n")).alias("digest"))


@query
def cache_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A18 over a request log: the first request of a key is a miss."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) == 1
    log = table(spark, d, "events").select(first.alias("miss"))
    hits = F.sum(F.when(F.col("miss"), 0).otherwise(1))
    return log.agg(hits.alias("hits"), F.sum(F.col("miss").cast("int")).alias("misses"), F.round(hits * 100.0 / F.count(F.lit(1)), 1).alias("ratio"))


# --- more of the lexicon --------------------------------------------------------------------------


@query
def category_list_ordered(spark: SparkSession, d: str) -> DataFrame:
    """T4: the first page of the list by display order and display name."""
    return catalog.in_display_order(adapters.categories(spark, d), "id").limit(checks.limit("10")).select("id", "name", F.coalesce("display_order", F.lit(-1)).alias("display_order"))


@query
def category_resolve(spark: SparkSession, d: str) -> DataFrame:
    """by id, by name, and none."""
    rows = adapters.categories(spark, d)
    found = [catalog.resolve(rows, x).select(F.lit(x).alias("reference"), "id", "name") for x in ("1003", "ASIA", "NOWHERE")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _placed_members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("category_id"), F.col("c_custkey").alias("word_id"), F.length("c_mktsegment").alias("display_order"))


@query
def category_page_full(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a category with nested words and the page's numbers."""
    name = "NATION_3"
    found = catalog.category_page(adapters.categories(spark, d), _placed_members(spark, d), adapters.words(spark, d), adapters.word_definitions(spark, d), name, "2", "10")
    digest = F.md5(F.array_join(F.transform("definitions", lambda x: F.concat(x.part_of_speech, x.definition_en)), ","))
    return found.select("category", "word_id", "word", "display_order", F.coalesce(F.size("definitions"), F.lit(0)).cast("long").alias("definitions"), F.coalesce(digest, F.lit("")).alias("digest"), "total", "total_pages", "has_more")


@query
def category_members_sorted(spark: SparkSession, d: str) -> DataFrame:
    """T5: words of a category by the display order of the membership, across the join, then by word."""
    rows = _placed_members(spark, d).filter("category_id = 5").join(adapters.words(spark, d).select(F.col("id").alias("word_id"), "word"), "word_id")
    return catalog.page(rows, ["display_order", "word", "word_id"], 1, 20).select("word_id", "word", "display_order")


@query
def word_autocomplete_hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions with their sound and part of speech."""
    hits = search.autocomplete(_customer_index(spark, d), "customer#0000001", checks.limit(None))
    found = search.hydrate(hits, adapters.word_pronunciations(spark, d), adapters.word_definitions(spark, d))
    return found.select("id", "word", F.coalesce("ipa", F.lit("")).alias("ipa"), F.coalesce("pos", F.lit("")).alias("pos"))


@query
def autocomplete_fallback(spark: SparkSession, d: str) -> DataFrame:
    """No hit gives the fixed words, a hit gives none of them."""
    index = _customer_index(spark, d)
    found = [search.suggestions(index, p, 2).select(F.lit(p).alias("prefix"), "word") for p in ("hel", "customer#00000000", "zzz")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def collation_order(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty of mixed-case names in the order of a collation."""
    name = F.when(F.col("c_nationkey") < 12, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    rows = table(spark, d, "customer").select(F.concat(name, F.col("c_custkey").cast("string")).alias("name"), "c_custkey")
    return rows.orderBy(text.collated(F.col("name")), "c_custkey").limit(20)


@query
def try_cast_ids(spark: SparkSession, d: str) -> DataFrame:
    """M2: what is a number and what is none."""
    raw = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(text.to_int(raw), F.lit(-1)).alias("number"))


@query
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """M7: the entries of two maps, the right one's first."""
    left = F.create_map(F.lit("a"), "o_orderstatus", F.lit("b"), F.lit("left"))
    right = F.create_map(F.lit("b"), "o_orderpriority", F.lit("c"), F.lit("right"))
    both = text.merge_maps(left, right)
    return table(spark, d, "orders").select("o_orderkey", F.size(both).cast("long").alias("n"), *[both[k].alias(k) for k in "abc"])


@query
def rank_list(spark: SparkSession, d: str) -> DataFrame:
    """Places in a list of words, 0 for others."""
    ranks = combine.rank_list(spark, ["nation_7", "nation_3", "nation_7", "nation_11"])
    return combine.ranked(table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("word")), ranks).select("n_nationkey", "frequency_rank")


@query
def request_record(spark: SparkSession, d: str) -> DataFrame:
    """One record from a request, normalised, appended to the definitions that are there."""
    record = {"word": "NATION_3", "language": "en", "definitions": [("noun", "a land", None, [("It is a land.", None)]), ("noun", "a place", None, [])], "synonyms": ["country"]}
    entry = combine.normalize(records.from_request(spark, record).withColumn("word", F.lower("word")))
    there = adapters.word_definitions(spark, d).select("part_of_speech", "definition_en")
    new = entry["definitions"].select("part_of_speech", "definition_en")
    after = mutate.import_entry({"definitions": there}, {"definitions": new})["definitions"]
    return after.groupBy("part_of_speech", "definition_en").agg(F.count(F.lit(1)).alias("n"))


@query
def import_rejects(spark: SparkSession, d: str) -> DataFrame:
    """A row per outcome of an import: there already, new, rejected."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    there = rows.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    problem = F.when(F.col("c_acctbal") < 0, "negative balance")
    after, rejects = mutate.import_valid(there, rows, ["c_name"], problem)
    return after.select("c_custkey", F.lit("kept").alias("outcome")).unionByName(rejects.select("c_custkey", F.col("problem").alias("outcome")))


@query
def create_categories(spark: SparkSession, d: str) -> DataFrame:
    """Segments and regions as new categories; known names and repeats are conflicts."""
    asked = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"))
    more = table(spark, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 1_000_000_000).cast("long").alias("seq"))
    outcomes = mutate.create_outcomes(adapters.categories(spark, d), asked.unionByName(more), ["name"], "conflict")
    return outcomes.groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def seed_categories(spark: SparkSession, d: str) -> DataFrame:
    """Nations and segments are seeded with customers as words."""
    customer = table(spark, d, "customer")
    known = adapters.categories(spark, d).select(F.col("id").cast("long").alias("id"), "name").filter("id < 12")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    seeds = customer.join(nation, "c_nationkey").select(F.col("c_custkey").alias("seq"), (F.col("c_nationkey") + 5000).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("c_name").alias("word"))
    members = customer.filter("c_acctbal < 0").select(F.col("c_nationkey").cast("long").alias("category_id"), F.col("c_custkey").alias("word_id"))
    words = customer.select(F.col("c_name").alias("word"), F.col("c_custkey").alias("word_id"))
    grown, after, outcomes = mutate.seed_categories(known, members, seeds, words)
    per = after.groupBy("category_id").agg(F.count(F.lit(1)).alias("words"))
    found = grown.join(outcomes.select("name", "status"), "name", "left").join(per, F.col("id") == F.col("category_id"), "left")
    return found.select("id", "name", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("words", F.lit(0).cast("long")).alias("words"))


@query
def remove_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the wish to remove a customer from those with a debt."""
    own = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("word_id"))
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("word_id"))
    left = mutate.delete_rows(own, asked, ["word_id"]).select(F.lit("left").alias("status"))
    return mutate.outcome_counts(mutate.remove_outcomes(own, asked, ["word_id"]).select("status").unionByName(left))


@query
def upsert_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules overwrite what is known of their categories, and obsolete categories without a rule go."""
    known = adapters.categories(spark, d).select("name", "topic")
    rules = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("name"), F.lit("overwritten").alias("topic"))
    more = rules.unionByName(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lit("brand").alias("topic")).distinct())
    return mutate.delete_obsolete(mutate.upsert(known, more, ["name"]), ["AFRICA", "NATION_1", "NATION_2"], more)


@query
def stamped_rows(spark: SparkSession, d: str) -> DataFrame:
    """M4: times of creation are kept, times of change are set; the time is given here."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("created_at"))
    return mutate.stamped(rows, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query
def recordings(spark: SparkSession, d: str) -> DataFrame:
    """The recordings to play for each word."""
    found = extern.recordings(adapters.recordings(spark, d))
    return found.select("word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("us", "uk", "for_us", "for_uk")])


@query
def audio_write_back(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that were found fill pronunciations that have none."""
    found = extern.recordings(adapters.recordings(spark, d)).select(F.col("word").alias("word_id"), F.col("for_us").alias("audio_url"))
    filled = mutate.write_back(adapters.word_pronunciations(spark, d), found, "word_id", "audio_url")
    return filled.select("id", F.coalesce("audio_url", F.lit("")).alias("audio_url"))


def _stub(word: str) -> list[dict]:
    """Stands for a dictionary service: it knows the words that do not end in a zero."""
    if word.endswith("0"):
        raise LookupError("No Definitions Found")
    senses = [{"definition": f"{word} {i}"} for i in range(3)]
    return [{"word": word, "meanings": [{"partOfSpeech": p, "definitions": senses, "synonyms": ["a", p]} for p in ("noun", "verb", "adj", "adv")]}]


@query
def fetched_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries from a client, cut to a few meanings, and failures as rows."""
    found = extern.fetch_entries(adapters.words(spark, d), _stub)
    zero = F.lit(0).cast("long")
    said = F.md5(F.array_join(F.transform("definitions", lambda x: F.concat(x.pos, F.lit(":"), x.definition_en)), ","))
    return found.select("word", F.coalesce(F.size("definitions").cast("long"), zero).alias("definitions"), F.coalesce(said, F.lit("")).alias("digest"), F.coalesce(F.array_join("synonyms", ","), F.lit("")).alias("synonyms"), F.coalesce("problem", F.lit("")).alias("problem"))


def _refuses(text: str) -> str:
    if text.startswith("1"):
        raise ConnectionError("primary is down")
    return f"first {text}"


@query
def translate_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Texts without a translation go to a service, and to another one where that fails."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.lit("there")).alias("vi"))
    return extern.translate_missing(rows, "o_orderpriority", "vi", extern.with_fallback(_refuses, lambda t: f"second {t}")).select("o_orderkey", "vi")


@query
def example_worklist(spark: SparkSession, d: str) -> DataFrame:
    """The first examples without a translation by the rank of their word."""
    found = quality.example_worklist(adapters.word_examples(spark, d).distinct(), adapters.word_definitions(spark, d), adapters.words(spark, d), 50)
    return found.select("definition_id", "id", "word", F.coalesce("frequency_rank", F.lit(-1)).alias("frequency_rank"))


@query
def lookup_nested(spark: SparkSession, d: str) -> DataFrame:
    """Every word with all its children."""
    found = lookup.lookup(
        adapters.words(spark, d), adapters.word_definitions(spark, d), adapters.word_examples(spark, d), adapters.word_pronunciations(spark, d), adapters.word_forms(spark, d), adapters.word_synonyms(spark, d)
    )
    return found.select("id", "word", *_said_of(found))


def _said_of(found: DataFrame) -> list:
    n = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(0).cast("long"))
    examples = F.aggregate(F.transform("definitions", lambda x: n(x.examples)), F.lit(0).cast("long"), lambda a, b: a + b)
    return [
        n("definitions").alias("definitions"), F.coalesce(examples, F.lit(0).cast("long")).alias("examples"), n("pronunciations").alias("pronunciations"), n("synonyms").alias("synonyms"), n("word_forms").alias("forms"),
        F.md5(F.coalesce(F.array_join(F.transform("definitions", lambda x: x.definition_en), ","), F.lit(""))).alias("digest"), F.coalesce(F.col("word_forms")["click"], F.lit("")).alias("click"),
    ]


@query
def word_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One word, by its normalised form."""
    word = lookup.find_word(adapters.words(spark, d), "customer#000000007")
    found = lookup.lookup(word, adapters.word_definitions(spark, d), adapters.word_examples(spark, d), adapters.word_pronunciations(spark, d), adapters.word_forms(spark, d), adapters.word_synonyms(spark, d))
    return found.select("id", "word", *_said_of(found))


@query
def cmudict_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were written as text files, read in file order and parsed."""
    return cmudict.parse(adapters.cmudict_lines(spark, d))


@query
def wordnet_parse(spark: SparkSession, d: str) -> DataFrame:
    """Synset and exception files, read and parsed."""
    folder = adapters.wordnet_files(spark, d)
    found = wordnet.parse(wordnet.read_synsets(spark, folder), wordnet.read_exceptions(spark, folder))
    return found.select("word", F.coalesce(F.size("synonyms").cast("long"), F.lit(-1).cast("long")).alias("synonyms"), F.coalesce(F.array_min("synonyms"), F.lit("")).alias("first"), F.coalesce(F.col("word_forms")["plural"], F.lit("")).alias("plural"))


@query
def wiktionary_parse(spark: SparkSession, d: str) -> DataFrame:
    """Pages of an XML dump, read and parsed."""
    found = wiktionary.parse(adapters.wiktionary_pages(spark, d))
    said = F.array_join(F.transform("definitions", lambda x: F.concat(x.pos, F.lit(":"), x.definition_en, F.lit(":"), F.array_join(F.transform(x.examples, lambda e: e.en), "/"))), ";")
    return found.select("word", said.alias("definitions"), F.array_join(F.transform("pronunciations", lambda p: F.concat(p.accent, p.ipa)), ",").alias("pronunciations"))


@query
def combine_sources(spark: SparkSession, d: str) -> DataFrame:
    """The three corpora merged by word."""
    found = adapters.merged_entries(spark, d)
    n = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(-1).cast("long"))
    return found.select("word", n("pronunciations").alias("pronunciations"), n("definitions").alias("definitions"), n("synonyms").alias("synonyms"), F.coalesce(F.get("definitions", F.lit(0))["level"], F.lit("")).alias("level"), "frequency_rank")


@query
def normalize_tables(spark: SparkSession, d: str) -> DataFrame:
    """The merged entries written and read as JSON, and the rows of each table that they make."""
    path = scratch_dir(spark)
    records.write_json(adapters.merged_entries(spark, d), path)
    tables = combine.normalize(records.read_json(spark, path))
    found = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        found = one if found is None else found.unionByName(one)
    return found.unionByName(records.truncated(found))
