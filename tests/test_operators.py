import pytest
from pyspark.sql import functions as F

from lexengine.functions import checks
from lexengine.operators import catalog, classify, combine, lookup, mutate, quality, search


def words(spark, rows):
    return spark.createDataFrame(rows, "id int, word string, frequency_rank int")


def test_autocomplete_cuts_before_it_ranks(spark):
    rows = words(spark, [(i, f"a{i:02}", 1 if i == 20 else None) for i in range(1, 21)])
    index = search.key_index(rows)
    assert "a20" not in [r.word for r in search.autocomplete(index, " A", 5).collect()]
    assert search.autocomplete(index, "a", 5, rank_first=True).first().word == "a20"
    assert search.autocomplete(index, "  ", 5).count() == 0
    assert [r.word for r in search.suggestions(index, "hel").collect()] == ["hello", "help", "helicopter"]


def test_prefix_is_pushed_down(spark, tmp_path):
    search.write_index(search.key_index(words(spark, [(1, "b", 1), (2, "a", None)])), str(tmp_path / "i"), 2)
    plan = search.autocomplete(spark.read.parquet(str(tmp_path / "i")), "a")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,a)" in plan


def test_category_and_topic_autocomplete(spark):
    rows = spark.createDataFrame([(i, f"t{i}", f"T{i}", "topic", i) for i in range(30)], "id int, name string, display_name string, topic string, word_count long")
    assert search.category_autocomplete(rows, "t", 4).count() == 2
    assert search.topic_autocomplete(rows, "to", 15).first().category_count == 15
    assert search.topic_autocomplete(rows, "to", 15, exact=True).first().category_count == 30


def test_counts_do_not_multiply(spark):
    categories = spark.createDataFrame([(1, "p", "t", None), (2, "c", "t", 1), (3, "d", "t", 1)], "id int, name string, topic string, parent_id int")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "category_id int, word_id int")
    row = catalog.category_list(categories, members, parent_only=True).first()
    assert (row.word_count, row.subcategory_count) == (3, 2)


def test_pages_make_up_the_whole(spark):
    rows = spark.range(25)
    pages = [r.id for n in (1, 2, 3) for r in catalog.page(rows, ["id"], n, 10).collect()]
    assert pages == list(range(25))
    assert tuple(catalog.page_meta(rows, 3, 10).first()) == (25, 3, False)


def test_categorize(spark):
    rules = (classify.Rule("war", "t", ("war", "genus ")), classify.Rule("sea", "t", ("SEA",)))
    definitions = spark.createDataFrame([("a", "Toward the sea"), ("a", "war"), ("b", "genus"), ("c", None)], "word string, definition_en string")
    got = sorted(map(tuple, classify.categorize(definitions, definitions, rules).collect()))
    assert got == [("a", "sea"), ("a", "war"), ("b", "others"), ("c", "others")]
    sub = classify.subcategorize(spark.createDataFrame(got, "word string, category string"), definitions, {"war": (classify.Rule("x", "t", ("none",)),)})
    assert list(map(tuple, sub.collect())) == [("war", "war-general", "a")]
    assert classify.rule_orders("p", rules, {"p-sea"}) == {"p-sea": 2}


def test_import_twice(spark):
    tables = {"words": spark.createDataFrame([(1, "a")], "id int, word string"), "pronunciations": spark.createDataFrame([], "word_id int, accent string"), "definitions": spark.createDataFrame([], "word_id int, d string")}
    entry = {"words": tables["words"], "pronunciations": spark.createDataFrame([(1, "US")], "word_id int, accent string"), "definitions": spark.createDataFrame([(1, "x")], "word_id int, d string")}
    twice = mutate.import_entry(mutate.import_entry(tables, entry), entry)
    assert {n: t.count() for n, t in twice.items()} == {"words": 1, "pronunciations": 1, "definitions": 2}


def test_outcomes(spark):
    requests = spark.createDataFrame([(1, "cat"), (2, "cat"), (3, "zzz")], "seq int, word string")
    found = mutate.add_outcomes(requests, spark.createDataFrame([("cat", 1)], "word string, word_id int"), spark.createDataFrame([], "word_id int"))
    assert {r.status: r.n for r in mutate.outcome_counts(found).collect()} == {"added": 1, "skipped": 1, "not_found": 1}
    new = mutate.user_import(spark.createDataFrame([("u", "dog")], "user_id string, word string"), spark.createDataFrame([("u", " Cat "), ("u", ""), ("u", "cat"), ("u", "dog")], "user_id string, word string"))
    assert list(map(tuple, new.collect())) == [("u", "cat")]


def test_markers_and_nulls(spark):
    rows = spark.createDataFrame([(1, "{{ux|a {{Q|b"), (2, None), (3, "x")], "id int, t string")
    hits = {r.marker: r.hits for r in quality.marker_counts(rows, "t").collect()}
    assert hits["{{ux|"] == hits["{{Q|"] == 1 and sum(hits.values()) == 2
    assert sorted(r.id for r in mutate.delete_like(rows, "t", quality.TEMPLATE_MARKERS).collect()) == [2, 3]
    empty = quality.coverage(rows.limit(0), {"t": F.col("t").isNotNull()}).first()
    assert tuple(empty) == (0, 0, None)


def test_lookup_nests(spark):
    base = spark.createDataFrame([(1, "w", None)], "id int, word string, frequency_rank int")
    definitions = spark.createDataFrame([(5, 1, "n", "two", None, "x", 2), (4, 1, "n", "one", None, "x", 1)], "id int, word_id int, part_of_speech string, definition_en string, definition_vi string, level string, definition_order int")
    examples = spark.createDataFrame([(9, 4, "e2", None), (8, 4, "e1", None)], "id int, definition_id int, example_en string, example_vi string")
    sounds = spark.createDataFrame([], "id int, word_id int, accent string, ipa string, audio_url string")
    forms = spark.createDataFrame([(1, 1, "past", "a"), (2, 1, "past", "b")], "id int, word_id int, form_type string, form_word string")
    synonyms = spark.createDataFrame([(1, 1, "s")], "id int, word_id int, synonym_word string")
    row = lookup.lookup(base, definitions, examples, sounds, forms, synonyms).first()
    assert [d.definition_en for d in row.definitions] == ["one", "two"] and [e.example_en for e in row.definitions[0].examples] == ["e1", "e2"]
    assert row.word_forms == {"past": "b"} and row.pronunciations is None


def test_parent_set_null(spark):
    children = spark.createDataFrame([(1, 7), (2, 8)], "id int, parent_id int")
    parents = spark.createDataFrame([(7,)], "id int")
    assert sorted(map(tuple, mutate.orphan(children, parents, "parent_id").collect())) == [(1, 7), (2, None)]


def test_requests_are_checked():
    assert [checks.limit(x) for x in (None, "", "7", 50)] == [15, 15, 7, 50] and checks.page("2", None) == (2, 20)
    for bad in (0, 51, "x", True, 1.5):
        with pytest.raises(ValueError, match="limit"):
            checks.limit(bad)


def test_references(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "1b")], "id int, name string")
    assert catalog.required(rows, "1").first().name == "a" and catalog.required(rows, "1b").first().id == 2
    with pytest.raises(checks.NotFoundError):
        catalog.required(rows, "zzz")


def test_creating_and_removing(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    assert mutate.create_unique(rows, spark.createDataFrame([(2, "b")], "id int, name string"), ["name"]).count() == 2
    for bad in ([(2, "a")], [(2, "b"), (3, "b")]):
        with pytest.raises(checks.ConflictError):
            mutate.create_unique(rows, spark.createDataFrame(bad, "id int, name string"), ["name"])
    assert mutate.remove_one(rows, F.col("name") == "a").count() == 0
    with pytest.raises(checks.NotFoundError):
        mutate.remove_one(rows, F.col("name") == "b")
    seen = {r.name: r.status for r in mutate.remove_outcomes(rows, spark.createDataFrame([("a",), ("b",)], "name string"), ["name"]).collect()}
    assert seen == {"a": "removed", "b": "not_found"}


def test_stamps(spark):
    row = mutate.stamped(spark.createDataFrame([(1,)], "id int")).first()
    assert row.created_at == row.updated_at and row.created_at is not None


def test_many_keywords_and_edges(spark):
    rules = tuple(classify.Rule(f"r{i}", "t", (f"key{i:04}x", "")) for i in range(130))
    rows = [("w", "KEY0000X and key0129x"), ("w", "key0129x"), ("v", None), (None, "key0007x"), ("u", "")]
    found = classify.categorize(None, spark.createDataFrame(rows, "word string, definition_en string"), rules).collect()
    assert sorted((r.word or "", r.category) for r in found) == [("", "r7"), ("u", "others"), ("v", "others"), ("w", "r0"), ("w", "r129")]
    empty = spark.createDataFrame([], "word string, definition_en string")
    assert classify.categorize(None, empty, rules).count() == 0 and classify.classify(empty).count() == 0
    assert classify.categorize(None, spark.createDataFrame(rows[:1], "word string, definition_en string"), ()).first().category == "others"


def test_one_scan_classifies(spark):
    plan = classify.classify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS word", "text AS definition_en"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_passages_are_classified_in_one_scan(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["subcategorize_passages"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("documents.parquet") == 1


def test_many_sub_rules(spark):
    """Rules at both ends of each number of a set of hits, and words that none of them matches."""
    rules = (classify.Rule("p", "t", ("pp",)), classify.Rule("q", "t", ("qq", "key0063x")), classify.Rule("bare", "t", ("zz",)))
    subrules = {"p": tuple(classify.Rule(f"{i}", "t", (f"key{i:04}x",)) for i in range(129)), "q": (classify.Rule("only", "t", ("key0060x",)),)}
    rows = [("a", "pp KEY0060x"), ("a", "key0061x key0128x"), ("b", "qq pp"), ("c", "key0063x key0000x"), ("d", None), ("e", "zz")]
    definitions = spark.createDataFrame(rows, "word string, definition_en string")
    want = [("p", "p-128", "a"), ("p", "p-60", "a"), ("p", "p-61", "a"), ("p", "p-general", "b"), ("q", "q-general", "b"), ("q", "q-general", "c")]
    assert sorted(map(tuple, classify.classify(definitions, rules, subrules).collect())) == want
    assert sorted(map(tuple, classify.subcategorize(classify.categorize(None, definitions, rules), definitions, subrules).collect())) == want


def test_first_match_keeps_the_row(spark):
    rows = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "k int, seq int, kind string")
    assert sorted(map(tuple, lookup.first_match(rows, "k", F.col("kind") == "b", ["seq"]).collect())) == [(1, 2, "b"), (2, 1, "a")]


def test_ranks(spark):
    ranks = combine.rank_list(spark, ["b", "a", "b"])
    found = combine.ranked(spark.createDataFrame([("a",), ("b",), ("c",)], "word string"), ranks)
    assert {r.word: r.frequency_rank for r in found.collect()} == {"a": 2, "b": 1, "c": 0}
