from pyspark.sql import functions as F

from lexengine.functions import wikitext
from lexengine.operators import combine
from lexengine.sources import cmudict, records, wiktionary, wordnet


def test_cmudict(spark, tmp_path):
    lines = [";;; comment", "", "READ  R EH1 D", "READ(1)  R IY1 D", "foo(2) F UW1", "CAT(1) K AE1 T", "DOG  D AO1 G", "DOG  D AA1 G", "VAR(1) V", "VAR  V AA1 R", "A.B X"]
    path = tmp_path / "dict.txt"
    path.write_text("\n".join(lines))
    got = {r.word: r.pronunciation for r in cmudict.parse(cmudict.read_lines(spark, str(path))).collect()}
    assert got == {"read": "R EH1 D", "cat": "K AE1 T", "dog": "D AA1 G", "var": "V AA1 R"}


def test_wordnet(spark, tmp_path):
    (tmp_path / "data.noun").write_text("  header\n00001 02 n 03 cat 0 true_cat 0 Feline 0 000 | gloss\n00002 02 n 02 cat 0 tom 0 000 | x\n00003 02 n zz x\n")
    (tmp_path / "noun.exc").write_text("mice mouse\n")
    (tmp_path / "verb.exc").write_text("tried try\nried try\nran run\n")
    got = {r.word: r for r in wordnet.parse(wordnet.read_synsets(spark, str(tmp_path)), wordnet.read_exceptions(spark, str(tmp_path))).collect()}
    assert got["cat"].synonyms == ["feline", "tom"] and got["feline"].synonyms == ["cat"]
    assert got["mouse"].word_forms == {"plural": "mice"} and got["try"].word_forms == {"past": "ried"}
    assert "run" not in got and "true cat" not in got


PAGE = """==English==
{{IPA|en|/lʌv/|UK}}
===Etymology===
# not a sense
===Noun===
# A [[cat]].
#: {{ux|en|A cat sleeps here.}}
#: {{syn|en|x}}
## sub sense
### deep
# ab
#* {{quote-book|en|title=T|passage=He {{w|ran}} home.|page=3}}
# Long {{quote-text|en
|text=one two
}} end
====Verb====
# To love.
==French==
# Autre
"""


def test_wiktionary(spark):
    pages = [("Love", PAGE), ("love", "==English==\n===Verb===\n# Second page."), ("Wiktionary:Foo", PAGE), ("ice cream", PAGE), ("well-known fact", PAGE), ("none", "==French==\n# x"), ("null", None)]
    got = {r.word: r for r in wiktionary.parse(spark.createDataFrame(pages, "title string, text string")).collect()}
    assert set(got) == {"love", "well-known fact"}
    love = got["love"]
    assert [(d.pos, d.definition_en) for d in love.definitions] == [("noun", "A cat."), ("noun", "sub sense"), ("noun", "Long one two end"), ("verb", "To love."), ("verb", "Second page.")]
    assert [e.en for e in love.definitions[0].examples] == ["A cat sleeps here."]
    assert [(p.accent, p.ipa) for p in love.pronunciations] == [("UK", "/lʌv/")]


def test_quotes():
    plain = lambda t: wikitext.read(t).text
    assert plain("a {{quote-book|en|title=T|passage=He {{w|x|ran}} home.|page=3}} b") == "a He ran home. b"
    assert plain("a {{quote-book|text=t|u}} {{quote-web|x}}") == "a t|u "
    assert plain("kept {{quote-book|lost") == "kept"


def test_templates_and_links():
    plain = lambda t: wikitext.read(t).text
    assert plain("[[a|b]] [[c]] [[d|e|f]] {{w|g}} {{w|h|i}} {{gloss|j}} {{context|k|l}} {{lb|en|m|n}}") == "b c e|f g i j (k|l) (m|n)"
    assert plain("{{x|{{y|[[z]]}}}}end {{defn|of {{gloss|a [[b|c]]}} d}}") == "end of a c d"
    assert plain("a | b }} c ]] d {{open|e [[f") == "a | b }} c ]] d {{open|e [[f"
    assert plain("[[a {{b]] {{w|c [[d}} e") == "a {{b c [[d e"
    assert plain("{{" * 50_000 + "w|deep" + "}}" * 50_000) == "" and plain("[[" * 50_000) == "[[" * 50_000
    assert wikitext.read("{{a|{{b|c}}|d}}").templates == [["b", "c"], ["a", "", "d"]]
    assert [wikitext.header(x) for x in ("==A==", "=== B c ===", "=D=", "====", "==E=", "x")] == [(2, "A"), (3, "B c"), None, None, None, None]


def test_xml(spark, tmp_path):
    path = tmp_path / "pages.xml"
    path.write_text("<m><page><title>A&amp;B</title><revision><text bytes='3'>x &lt;y&gt;</text></revision></page><page><title>C</title><revision><text bytes='1'>z</text></revision></page></m>")
    assert sorted(map(tuple, wiktionary.read_pages(spark, str(path)).collect())) == [("A&B", "x <y>"), ("C", "z")]


def test_one_file_of_pages_is_read_and_parsed_by_many_tasks(spark, tmp_path):
    page = "<page>\n<title>{0}</title>\n<revision><text bytes='9'>==English==\n===Noun===\n# A thing &amp;lt; {0}.</text></revision>\n</page>\n"
    names = sorted(f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")
    (tmp_path / "dump.xml").write_text("<pages>\n<siteinfo>x</siteinfo>\n" + "".join(page.format(n) for n in names) + "</pages>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        pages = wiktionary.read_pages(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() > 3
        assert sorted(r.title for r in pages.collect()) == names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = wiktionary.parse(pages.coalesce(1)).select("word", F.col("definitions")[0]["definition_en"].alias("said")).collect()
    assert sorted((r.word, r.said) for r in found) == [(n, f"A thing < {n}.") for n in names]
    assert "Exchange hashpartitioning(title" in wiktionary.parse(pages.coalesce(1))._jdf.queryExecution().toString()
    # By number, so that parts of few bytes are not put together again.
    assert "REPARTITION_BY_NUM" in wiktionary.parse(pages)._jdf.queryExecution().toString()
    assert wiktionary.sounds(["{{I{{w|P}}A|en|/a/, /b/|UK}}", "{{IPA|en|a}}"]) == [{"said": "/a/, /b/|UK", "ipa": "/a/"}] and wiktionary.sounds(["{{IPA|en|a/b}}"]) == []


def test_places_in_files_leave_out_the_folder(spark, tmp_path):
    for name, lines in (("part-10", ["a", "b"]), ("part-9", ["c"])):
        (tmp_path / "with blank").mkdir(exist_ok=True)
        (tmp_path / "with blank" / name).write_text("\n".join(lines))
    rows = cmudict.read_lines(spark, str(tmp_path / "with blank")).orderBy("line").collect()
    assert [r.value for r in rows] == ["a", "b", "c"]
    assert [r.line[0] for r in rows] == ["part-10", "part-10", "part-9"]


def test_synset_lines_are_split_once(spark):
    lines = spark.createDataFrame([("noun", 1, "00000001 02 n 03 A_b 0 C 0 d 0 000 | x"), ("noun", 2, "00000002 02 n 04 e 0 f"), ("noun", 3, "00000003 02 n zz e 0"), ("noun", 4, "00000004 02 n 00 e 0"), ("noun", 5, "00000005")], "pos string, line int, value string").repartition(1)
    words = wordnet.synset_words(lines)
    assert sorted((r.line, r.words) for r in words.collect()) == [(1, ["a b", "c", "d"]), (2, ["e", "f"])]
    assert words._jdf.queryExecution().optimizedPlan().toString().count("|, -1)") == 1
    assert {r.word: r.synonyms for r in wordnet.synonyms(words).collect()} == {"c": ["d"], "d": ["c"], "e": ["f"], "f": ["e"]}


def test_combine_and_normalize(spark, tmp_path):
    wiki = spark.createDataFrame(
        [("cat", [("UK", "/x/")], [("noun", "A cat.", [("He has a cat.",)])]), ("empty", [], [])],
        "word string, pronunciations array<struct<accent string, ipa string>>, definitions array<struct<pos string, definition_en string, examples array<struct<en string>>>>",
    )
    cmu = spark.createDataFrame([("cat", "/k/"), ("dog", "/d/"), ("zzz", "/z/")], "word string, ipa string")
    net = spark.createDataFrame([("dog", ["hound"] * 12, {"plural": "dogs"}), ("zzz", [], None)], "word string, synonyms array<string>, word_forms map<string,string>")
    rows = combine.combine(wiki, cmu, net)
    got = {r.word: r for r in rows.collect()}
    assert set(got) == {"cat", "dog"}
    assert [(p.accent, p.ipa) for p in got["cat"].pronunciations] == [("UK", "/x/"), ("US", "/k/")]
    assert got["cat"].definitions[0].level == "beginner" and len(got["dog"].synonyms) == 10
    tables = combine.normalize(rows)
    assert {n: t.count() for n, t in tables.items()} == {"words": 2, "definitions": 1, "examples": 1, "pronunciations": 3, "synonyms": 10, "word_forms": 1}
    records.write_json(rows, str(tmp_path / "j"))
    assert records.read_json(spark, str(tmp_path / "j")).count() == 2
    assert records.read_json(spark, str(tmp_path / "missing")).count() == 0


def test_files_are_read_in_order(spark, tmp_path):
    folder = tmp_path / "dict"
    folder.mkdir()
    (folder / "part-1.txt").write_text("DOG  D AO1 G\nDOG  D AA1 G\n")
    (folder / "part-0.txt").write_text("DOG  K AE1 T\n" * 2000)
    assert cmudict.parse(cmudict.read_lines(spark, str(folder))).first().pronunciation == "D AA1 G"


def test_json_forms(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n {"word": "a"},\n {"word": "b"}\n]\n')
    (tmp_path / "lines.json").write_text('{"word": "a"}\n{"word": "b"}\n{"word": "c"}\n')
    (tmp_path / "empty.json").write_text("")
    assert [records.read_json(spark, str(tmp_path / f"{n}.json")).count() for n in ("array", "lines", "empty")] == [2, 3, 0]
    assert records.from_request(spark, {"word": "x", "synonyms": ["y"]}).first().synonyms == ["y"]
