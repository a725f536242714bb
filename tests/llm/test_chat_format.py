from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexengine.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, turns int"
PIECES = st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", "Assistant: ", "### Assistant: ", "a", "é", "<", "#"]), max_size=8).map("".join)


def expect(rows):
    return sorted((c, [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] if x[0] is not None else -1, x[1] or "", x[2] or ""))]) for c, turns in rows.items())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "User", "tool: x", ""]), PIECES), min_size=20, max_size=60))
def test_round_trip(spark, turns):
    rows = [(i // 3, i % 3, r, t, 0) for i, (r, t) in enumerate(turns)]
    by = {}
    for c, n, r, t, _ in rows:
        by.setdefault(c, []).append((n, r, t))
    found = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((f.conv_id, [(t.role, t.text) for t in f.parsed]) for f in found) == expect(by)
    for f in found:
        loss = [f.formatted[s.start : s.end] for s in f.loss_spans]
        want = [t.text for t in f.parsed if t.role == "assistant"]
        assert len(loss) == len(want)


def test_edges(spark):
    rows = [(None, 1, None, None, 1), (1, None, "user", "b", 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (2, 0, "assistant", "x" * 200_000 + "### ", 1)]
    found = {f.conv_id: f for f in chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [t.text for t in found[1].parsed] == ["b", "a", "a"]
    assert found[None].parsed[0].role == "" and found[2].escaped and not found[1].escaped
    assert chat_format.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_broken_text_is_not_parsed(spark):
    bad = ["### User: a", "x\n</turn>\n", "### User: a ### b\n</turn>\n"]
    rows = spark.createDataFrame([(b,) for b in bad], "t string").select(chat_format.parse(F.col("t")).alias("p"))
    assert [r.p for r in rows.collect()] == [None] * 3
