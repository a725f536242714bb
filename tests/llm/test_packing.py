import gc
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexengine.llm import packing
from lexengine.llm.common import in_arrow, table

DATA = "/root/testdata/sf0.001"
PIECES = st.lists(st.sampled_from([" ", "  ", "a", "The", "é", ".", ",\n", "\n\n", "'s", "12", "-", "ж", "\t", "\x00", "<|endoftext|>", "\xa0"]), max_size=12).map("".join)


@settings(max_examples=30, deadline=None)
@given(st.lists(PIECES, max_size=40))
def test_chunks_encode_as_whole_texts(texts):
    own = packing.encoder(packing.default_tokenizer())
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want


#: All that Unicode, Python or the pre-tokenizer may take for white space, and their neighbours.
ODD = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x22), 0x7F, 0x84, 0x85, 0x86, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x1FFF, 0x2010), *range(0x2027, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(" \xa0\u3000\u2009a"), st.sampled_from(ODD), st.sampled_from(["mot", "1", "!", "'s", "é"])), max_size=10).map("".join), min_size=50, max_size=50))
def test_chunks_beside_all_white_space(texts):
    own = packing.encoder(packing.default_tokenizer())
    texts += ["a \xa0 \xa0", "\xa0 \xa0", "a\xa0 b", "a \x0b b", "a \x85"]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want


def test_every_character_beside_blanks():
    own = packing.encoder(packing.default_tokenizer())
    marks = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(ODD)
    texts = [t for c in marks for t in (f"a {c} {c}b {c}{c} ", f"{c} {c}")]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want


def test_chunks_are_forgotten_and_long_ones_not_kept(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 2)
    own = packing.ChunkEncoder(packing.default_tokenizer())
    for texts in (["a b c d", None, "x " + "y" * 50], ["", "b c", "d yy b"], ["c  d", "b " + "y" * 50, " b"]):
        want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids, ends = own.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want
        assert all(len(chunk) <= packing.CACHED_CHARS for chunk in own.numbers)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=9))
def test_no_packing_goes_below_the_bound(sizes):
    assert packing.least_bins(np.array(sizes, int), 100) <= fewest(sizes, 100)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300), st.integers(0, 5))
def test_packing_is_sound_and_search_never_hurts(sizes, seed):
    sizes = np.array(sizes, int)
    first = packing.best_fit(sizes, 100)
    found = packing.improve([list(b) for b in first], sizes, 100, seed=seed)
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 100 for b in found) and -(-sizes.sum() // 100) <= len(found) <= len(first)


def test_search_saves_bins():
    sizes = np.random.default_rng(0).integers(20, 70, 2000)
    first = packing.best_fit(sizes, 100)
    assert len(packing.improve(first, sizes, 100)) < len(first)


def test_documents(spark):
    docs = table(spark, DATA, "documents")
    found = packing.pack_documents(docs, packing.default_tokenizer(), block_pieces=100).toPandas()
    own = packing.encoder(packing.default_tokenizer())
    for r in docs.collect():
        ids = own.tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        mine = found[found.doc_id == r.doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[1:] == 1024).all() and (mine.start == mine.length.cumsum() - mine.length).all()
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    ordered = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (ordered.length.cumsum() - ordered.length.transform(lambda x: x) == found.sort_values(["sequence_id", "offset"]).offset).all()
    assert ordered.length.sum().max() <= 1024


def test_edges(spark):
    schema = "doc_id long, text string, length int, block int"
    rows = [(1, None, 1, 1), (1, None, 1, 1), (None, "a b", 2, 2), (2, "x " * 3000, 1, 1)]
    found = packing.pack_documents(spark.createDataFrame(rows, schema), packing.default_tokenizer()).collect()
    assert sum(r.doc_id == 1 and r.length == 1 for r in found) == 2 and sum(r.doc_id == 2 for r in found) == 3
    assert packing.pack_documents(spark.createDataFrame([], schema), packing.default_tokenizer()).count() == 0


def fewest(sizes, length):
    """The least number of bins, by trying all subsets as the last one."""
    n = len(sizes)
    total = [sum(sizes[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        low, rest = m & -m, m & (m - 1)
        sub = rest
        while True:
            if total[sub | low] <= length:
                best[m] = min(best[m], best[m ^ sub ^ low] + 1)
            if not sub:
                break
            sub = (sub - 1) & rest
    return best[-1]


def test_search_against_the_optimum():
    draw = np.random.default_rng(3)
    optimum = found = first = 0
    for _ in range(150):
        sizes = draw.integers(15, 60, 9)
        bins = packing.best_fit(sizes, 100)
        first += len(bins)
        found += len(packing.improve([list(b) for b in bins], sizes, 100))
        optimum += fewest(sizes.tolist(), 100)
    assert optimum <= found < first and found - optimum <= (first - optimum) // 2


def test_underfull_sequences_of_all_blocks_are_packed_anew(spark):
    draw = np.random.default_rng(0)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(draw.integers(1, 600, 3000))]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    found = packing.pack(cut, block_pieces=100).toPandas()
    assert len(found) == len(rows) and found.groupby("sequence_id").length.sum().max() <= 1024
    assert found.sequence_id.nunique() <= -(-sum(r[3] for r in rows) // 1024) + 1
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_workers_of_other_stages_hold_no_encoder(spark):
    docs = spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", "repeat('so many words ', 20) AS text")
    assert packing.pieces(docs, packing.default_tokenizer()).count() == 64

    def held(batches):
        for batch in batches:
            alive = sum(isinstance(x, packing.ChunkEncoder) for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"n": [alive] * batch.num_rows})

    assert {r.n for r in in_arrow(docs.select("doc_id"), held, "n long").collect()} == {0}


def test_large_batches_are_encoded_in_slices():
    texts = ["word " * 1000] * 1000 + ["", None, "x" * 3_000_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1003)), "text": pa.array(texts, pa.string())})
    parts = list(packing._slices(iter([batch.slice(0, 0), batch])))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert max(p.nbytes for p in parts[:2]) <= 2 * packing.ENCODED_BYTES and len(parts) > 4
