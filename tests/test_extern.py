import pytest
from pyspark.sql import functions as F

from lexengine.operators import extern, mutate
from lexengine.streaming import imports
from lexengine.streaming.counts import windowed_counts


def test_replies():
    assert extern.parse_reply('Here is the entry: {"word":"x"} done') == {"word": "x"}
    with pytest.raises(ValueError, match="Failed to parse"):
        extern.parse_reply("no json here")
    assert extern.parse_sentences("Short.\n  A long sentence.  \nAnother long one.", 1) == ["A long sentence."]
    with pytest.raises(ValueError, match="Failed to generate"):
        extern.parse_sentences("   \n  \n", 3)


def test_fetched_entry():
    meaning = {"partOfSpeech": "noun", "definitions": [{"definition": str(i)} for i in range(4)], "synonyms": ["a", "b", "a"]}
    entry = extern.fetched_entry([{"word": "w", "meanings": [meaning] * 5}, {"word": "other"}])
    assert len(entry["definitions"]) == 6 and entry["synonyms"] == ["a", "b"]


def test_fallback(spark):
    def broken(_):
        raise OSError

    assert extern.with_fallback(broken, str.upper)("a") == "A"
    with pytest.raises(extern.TranslationError):
        extern.with_fallback(broken, broken)("a")
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, None)], "id int, en string, vi string")
    assert sorted(map(tuple, extern.translate_missing(rows, "en", "vi", lambda t: t + "!").collect())) == [(1, "a", "a!"), (2, "b", "x"), (3, None, None)]


def test_recordings(spark):
    rows = spark.createDataFrame([("a", 1, "x-uk.mp3"), ("a", 2, "y.mp3"), ("b", 1, "y.mp3"), ("c", 2, "2-us.mp3"), ("c", 1, "1-us.mp3")], "word string, seq int, url string")
    got = {r.word: (r.us, r.uk, r.for_us, r.for_uk) for r in extern.recordings(rows).collect()}
    assert got == {"a": (None, "x-uk.mp3", "x-uk.mp3", "x-uk.mp3"), "b": ("y.mp3", None, "y.mp3", "y.mp3"), "c": ("1-us.mp3", None, "1-us.mp3", "1-us.mp3")}


def test_windowed_counts_in_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = windowed_counts(events)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("counts").selectExpr("sum(n)").first()[0] == batch.selectExpr("sum(n)").first()[0] == events.count()


def test_fetching_tells_failures(spark):
    def fetch(word):
        if word == "bad":
            raise KeyError("gone")
        return [{"word": word, "meanings": []}]

    rows = extern.fetch_entries(spark.createDataFrame([("a",), ("bad",), (None,)], "word string"), fetch).collect()
    assert sorted((r.word, r.definitions, r.problem) for r in rows) == [("a", [], None), ("bad", None, "'gone'")]


def test_import_as_a_stream_is_the_bulk_import(spark, tmp_path):
    """Batches that are run again after a lost commit, and rows that come again after a restart, change nothing."""
    source, folder, schema = tmp_path / "in", str(tmp_path / "out"), "word string, lang string, n int"
    known = spark.createDataFrame([("there", "en")], "word string, lang string")
    problem = F.when(F.col("n") < 0, "negative")

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
        imports.start_import(stream, known, ["word", "lang"], problem, folder).awaitTermination()
        good, bad = imports.imported(spark, folder, schema)
        return sorted(map(tuple, good.collect())), sorted(map(tuple, bad.collect()), key=repr)

    assert [df.count() for df in imports.imported(spark, folder, schema)] == [0, 0]
    first = [("a", "en", 1), ("a", "en", 1), ("there", "en", 5), ("b", "en", -1), (None, "en", 3), ("a", "fr", 2)]
    put("one", first)
    put("two", [("c", "en", 4), ("a", "en", 9), ("b", "en", 7)])
    want = [("a", "en", 1), ("a", "fr", 2), ("b", "en", 7), ("c", "en", 4)], [("b", "en", -1, "negative"), (None, "en", 3, "no key")]
    assert run() == want and run() == want
    # The last batch was written, but its commit is lost: it runs again.
    commits = tmp_path / "out" / "checkpoint" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    put("three", [*first, ("d", "en", 6)])
    assert run() == (sorted([*want[0], ("d", "en", 6)]), want[1])
    # The same keys as those of a bulk import of all rows at once.
    rows = spark.createDataFrame([*first, ("c", "en", 4), ("a", "en", 9), ("b", "en", 7), ("d", "en", 6)], schema)
    table, rejected = mutate.import_valid(known.withColumn("n", F.lit(0)), rows, ["word", "lang"], F.when(F.col("word").isNull(), "no key").otherwise(problem))
    assert sorted((r.word, r.lang) for r in table.collect()) == sorted([("there", "en"), *(r[:2] for r in run()[0])])
    assert {r.word for r in rejected.collect()} == {r[0] for r in run()[1]}
