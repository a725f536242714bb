from pyspark.sql import functions as F

from lexengine.functions import text


def values(spark, rows, *columns, schema="a string, b string"):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize_key_strips_all_white_space(spark):
    assert values(spark, [("  Love\t\n", None), (None, None)], text.normalize_key(F.col("a"))) == [("love",), (None,)]


def test_arpabet(spark):
    rows = [("HH AH0 L OW1", None), ("K AE1 T XX", None), ("", None)]
    assert values(spark, rows, text.arpabet_to_ipa(F.col("a"))) == [("/hʌlˈoʊ/",), ("/kˈæt/",), ("//",)]


def test_inflection(spark):
    rows = [("mice", "noun"), ("ran", "verb"), ("tried", "verb"), ("better", "adj"), ("more", "adv")]
    assert [r[0] for r in values(spark, rows, text.inflection(F.col("a"), F.col("b")))] == ["plural", None, "past", "comparative", None]


def test_levels(spark):
    rows = [(1000, "abcdefghi"), (1001, "a"), (5000, "a"), (5001, "a"), (None, "abcde"), (None, "abcdef"), (None, "abcdefgh"), (0, "abcdefghi")]
    got = values(spark, rows, text.level(F.col("a"), F.col("b")), schema="a int, b string")
    assert [r[0] for r in got] == ["beginner", "intermediate", "intermediate", "advanced", "beginner", "intermediate", "intermediate", "advanced"]


def test_clean_wikitext(spark):
    rows = [("{{lb|en|archaic}} A [[cat|feline]] &amp;lt;b&gt; '''big'''  {{x|{{y}}}}end<ref>kept</ref>", None)]
    assert values(spark, rows, text.clean_wikitext(F.col("a"))) == [("(archaic) A feline big endkept",)]


def test_sentences_and_json(spark):
    rows = [("0123456789\n 01234567890 \nshort\nanother long line", 'Here: {"word":"x"} ok'), ("", "no json")]
    got = values(spark, rows, text.sentences(F.col("a"), 3), text.json_in_prose(F.col("b")))
    assert got == [(["01234567890", "another long line"], '{"word":"x"}'), ([], "")]


def test_audio(spark):
    rows = [("a-us.mp3", "US"), ("x/uk/y.mp3", "UK"), ("z.mp3", None)]
    assert [r[0] for r in values(spark, rows, text.audio_accent(F.col("a")))] == ["us", "uk", None]
    assert values(spark, [(None, "k"), ("s", "k")], text.preferred_audio(F.col("a"), F.col("b"), "US")) == [("k",), ("s",)]


def test_maps_numbers_and_collation(spark):
    pairs = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}), (None, {"x": "y"}), ({"x": "y"}, None)], "l map<string,string>, r map<string,string>")
    assert [r[0] for r in pairs.select(text.merge_maps(F.col("l"), F.col("r"))).collect()] == [{"a": "1", "b": "2"}, {"x": "y"}, {"x": "y"}]
    assert values(spark, [("12", ""), ("1x", ""), (None, "")], text.to_int(F.col("a"))) == [(12,), (None,), (None,)]
    names = spark.createDataFrame([(c,) for c in "BaAfébcd"], "a string").orderBy(text.collated(F.col("a"))).collect()
    assert "".join(r.a for r in names) == "aABbcdéf".replace("Bb", "bB")
