import collections

import pyarrow as pa

import corpus_pipeline
from lexengine.llm import mixing, packing, quality
from lexengine.llm.common import scratch, shared_dir, stored, table
from tests.llm.brute import WORD, link_components

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    kept = [table(spark, DATA, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], DATA)))
    for docs in kept[1:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS
    rows = [[tuple(r) for r in docs.collect()] for docs in kept[:-1]]
    ranker = quality.train(kept[0], table(spark, DATA, "labels"))
    good = {r.doc_id for r in quality.classify(kept[0], ranker, ["doc_id"]).filter("predicted = 1").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in good)
    last = {}
    for r in rows[1]:
        last[r[1]] = max(last.get(r[1], r), r)
    assert sorted(rows[2]) == sorted(last.values())
    names = link_components([(r[0], r[1]) for r in rows[2]])
    assert sorted(rows[3]) == sorted(r for r in rows[2] if names[r[0]][1] == r[0])
    taken = {r.doc_id: r.taken for r in mixing.mix(kept[3]).collect()}
    words = collections.Counter()
    for r in rows[4]:
        words[r[0]] += len(WORD.findall(r[1]))
        assert len(r[1]) == r[4]
    assert words == collections.Counter({i: n for i, n in taken.items() if n})
    ids = packing.encoder(packing.default_tokenizer())
    tokens = len(ids.encode(pa.array([r[1] for r in rows[4]]))[0]) + len(rows[4])
    assert sum(r.length for r in kept[5].collect()) == tokens


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, c), (0, a + " more"), (None, b), (None, b + " more"), (2, a + " other"), (2, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.dissimilar_documents(spark, docs, DATA).collect()]
    assert sum(i is None for i, _ in kept) == 1
    assert sorted((i, t or "") for i, t in kept if i is not None) == [(0, a + " more"), (1, c), (2, ""), (2, "")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, last string, size long, loc string, score double, key string"


def test_edges_of_all_stages(spark):
    """Nulls everywhere, empty and very long texts, ties, rows that repeat, clashing columns, empty tables."""
    plain = " ".join(f"word{i}" for i in range(40))
    rows = [(1, plain), (1, plain), (2, plain), (3, None), (4, ""), (None, None), (None, "alone " + plain[::-1]), (5, "tall " * 60_000), (6, plain + " more")]
    docs = spark.createDataFrame([(i, t, None, None if i in (None, 6) else "s", None, "x", 1, "x", 0.5, "x") for i, t in rows], SCHEMA)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = stored(stage(spark, docs, "/root/testdata/sf0.001"))
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    text = lambda name: sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in found[name].collect())
    assert found["quality classifier"].columns == corpus_pipeline.COLUMNS
    assert text("exact dedup") == sorted([(2, plain), (4, ""), (-1, "alone " + plain[::-1]), (5, "tall " * 60_000), (6, plain + " more")])
    similar = text("n-gram Jaccard join")
    assert [i for i, t in similar if t.startswith("word")] == [1] and sum(t == "" for _, t in similar) == 3 and len(similar) == 6
    sizes = collections.Counter()
    for i, t in text("mixing sources to target weights"):
        sizes[i] += len(WORD.findall(t))
    want = {-1 if r.doc_id is None else r.doc_id: 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        want[-1 if r.doc_id is None else r.doc_id] += r.taken
    assert sizes == collections.Counter({i: n for i, n in want.items() if n}) and sum(want.values()) > 0
    packed = found["best-fit packing"].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in packed) <= 1024
    assert found["best-fit packing"].filter("piece = 0").count() == len(rows)


def test_scratch_is_deleted(spark):
    import pathlib

    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "lexengine"
    before = set(root.iterdir())
    result = shared_dir(spark)
    with scratch(spark):
        stored(spark.range(3))
        kept = stored(spark.range(4), result)
    assert {str(p) for p in set(root.iterdir()) - before} == {result} and kept.count() == 4
