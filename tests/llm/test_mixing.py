from pyspark.sql import functions as F

from lexengine.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, key int"


def test_edges(spark):
    rows = [(1, None, None, "", 1), (1, "a b c", "x", "", 1), (None, " \n", "x", "", 1), (3, "q w e r t", "y", "", 1), (4, "q w e r t", "z", "", 1), (4, "q w e r t", "z", "", 1)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA), range_rows=1).collect()
    assert len(found) == 6 and all(r.taken <= 2 * r.size for r in found)
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
    # 27 words are asked for; x can give 6 only, y and z share the rest 1 to 2.
    assert {s: rs[0].target for s, rs in by.items()} == {None: 0.0, "x": 6.0, "y": 7.0, "z": 14.0}
    assert all(sum(r.taken for r in rs) == round(rs[0].target) for rs in by.values())
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_do_not_matter(spark):
    rows = [(i, "w " * (i % 13), f"s{i % 3 if i % 2 else 0}", "", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, mixing.mix(docs, range_rows=10**6).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(7), range_rows=9).collect()))


def test_first_words():
    assert mixing.first_words(" a  b\tc ", 2) == " a  b" and mixing.first_words("a", 0) == "" and mixing.first_words("a", 5) == "a"


def test_ends_tell_what_is_taken(spark):
    """Repeated rows, ties, nulls and a source at its cap: the same words as by the running sums."""
    rows = [(i % 90 if i % 7 else None, "w " * (i % 5), None if i % 11 == 0 else f"s{i % 4}", str(i), i) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source", F.col("key").alias("place"))
    until = mixing.ends(mixing.mix(docs, extra=["place"], range_rows=20), ["place"])
    assert until.count() == 5
    by_sum = {r.place: r.taken for r in mixing.mix(docs, extra=["place"]).collect()}
    assert {r.place: r.taken for r in mixing.taken_up_to(docs, until, ["place"]).collect()} == by_sum
    assert any(by_sum.values())


def test_carried_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", 1), (2, "d", None, "y", 2)], "doc_id long, text string, source string, size string, extra int")
    found = mixing.mix(docs, extra=["size", "extra", "source"])
    assert sorted((r.doc_id, r.size, r.extra) for r in found.collect()) == [(1, 3, 1), (2, 1, 2)]
