from pyspark.sql import functions as F

from lexengine.llm import exact_dedup
from lexengine.llm.common import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, loc string, digest int"


def test_edges(spark):
    rows = [(1, "a", "x", 1), (1, "a", "y", 2), (None, None, None, None), (4, "", "q", 4), (5, "b" * 100_000, "q", 5)]
    found = exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in found) == [(-1, 4, 2), (1, 1, 2), (1, 1, 2), (4, 4, 2), (5, 5, 1)]
    assert sum(r.kept for r in found) == 3
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collisions_and_batches(spark):
    """With a digest of one byte nearly all hits are false ones; the bytes decide."""
    docs = table(spark, DATA, "documents").repartition(3)
    short = exact_dedup.dedup(docs, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), files_per_batch=1)
    whole = exact_dedup.dedup(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, short.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_a_group_of_many_replicas(spark):
    """More copies than meet one replica of the text that stays, and a few other texts behind the same short digest."""
    n = 3 * exact_dedup.COPIES_PER_REPLICA + 7
    rows = [(i, "same", "x", 1) for i in range(n)] + [(n + i, f"other {i % 3}", "y", 2) for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for digest in (exact_dedup.sha256_digest, lambda t: F.unhex(F.lit("00"))):
        found = exact_dedup.dedup(docs, digest=digest).collect()
        by = {}
        for r in found:
            by.setdefault(r.text_sha256, []).append(r)
        assert sorted(len(g) for g in by.values()) == [3, 3, 3, n]
        for g in by.values():
            assert {(r.keep_id, r.group_size) for r in g} == {(max(r.doc_id for r in g), len(g))} and [r.doc_id for r in g if r.kept] == [g[0].keep_id]
