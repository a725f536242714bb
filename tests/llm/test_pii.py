import collections
import hashlib
import re
import time

from hypothesis import example, given, settings
from hypothesis import strategies as st

from lexengine.llm import pii
from lexengine.llm.common import table
from tests.llm.brute import base_spans

SCHEMA = "doc_id long, text string, spans string, kind int"


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+- (0)9_%b", max_size=40))
@example("1.2.3.4.5.6.7.8")
@example("a@b@c.d.e@f.g")
def test_base_spans(text):
    assert pii.base_spans(text) == base_spans(text)


def test_query(spark):
    data = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in pii.op9_pii(spark, data).collect()}
    for r in table(spark, data, "documents").collect():
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(r.text))
        assert found[r.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(found[r.doc_id].spans.split(","))


def test_query_counts_each_kind(spark, tmp_path):
    texts = ["1.2.3.4 and 5.6.7.8 and a@b.c", "+12345678901 1.2.3.4", "x@y.z x@y.z 1.1.1.1 4111 1111 1111 1111 +1 555 8718819", "", None]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)] + [(None, "a@b.c", "", 0), (0, "a@b.c", "", 0), (0, "a@b.c", "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op9_pii(spark, str(tmp_path)).collect())
    assert found == collections.Counter((i, *(sum(k == n for _, k, _ in base_spans(t or "")) for n in range(4))) for i, t, _, _ in rows)
    assert (0, 1, 2, 0, 0) in found


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please contact me at user{i}@mail.example.com now thanks ip is 10.0.0.{i} ok", "", 0) for i in range(40)]
    rows += [(100, "please contact me at user-x7 now thanks", "", 0), (101, "ip is 10.0.0 ok", "", 0), (102, None, "", 0), (None, "", "", 0), (100, "please contact me at user-x7 now thanks", "", 0), (103, "nobody is 77x here", "", 0)]
    found = pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    spans = sorted((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in found if r.doc_id is not None and r.doc_id >= 100)
    assert spans == [(100, [(21, 0, 28)]), (100, [(21, 0, 28)]), (101, [(6, 1, 12)]), (102, []), (103, [])]
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_words_are_no_patterns(spark):
    """A context that mostly holds other words says nothing."""
    rows = [(i, f"all of the {'x' + str(i) + '@a.example.com' if i < 4 else 'people'} here", "", 0) for i in range(60)] + [(99, "all of the b2b here", "", 0)]
    found = pii.extract(spark.createDataFrame(rows, SCHEMA)).filter("doc_id = 99").first()
    assert found.spans == []


def test_long_runs_stay_linear():
    text = "1" * 200_000 + " " + "a" * 200_000 + " @ " + "+1" * 1000
    assert pii.base_spans(text) == []


def test_runs_of_zeros_are_numbers():
    for text in ("0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "7", "0" * 5000 + ".1.1.256", "0.00.000.0000"):
        assert pii.base_spans(text) == ([] if "256" in text else [(0, 1, len(text))])


def test_many_spans_in_one_text_take_seconds(spark):
    long = " ".join(f"mail u{i}@a.example.com or 7-{i}-x and" for i in range(50_000))
    docs = spark.createDataFrame([(1, long, "", 0)], SCHEMA)
    began = time.time()
    found = pii.extract(docs).first()
    assert len(found.base) == 50_000 and time.time() - began < 60


def test_overlapping_base_spans_hide_the_words_they_touch():
    text = "a +1 555 010 1234 4111 1111 1111 1111 x1y +49 30 123456 5500 0000 0000 0004"
    base = pii._Base(text)
    for m in re.finditer(r"\S+", text):
        assert base.identifier(*m.span())[0] == any(a < m.end() and m.start() < b for a, _, b in pii.base_spans(text))


def test_long_words_are_context(spark):
    """Words beyond MAX_CONTEXT, or with the mark between words, teach like any other."""
    for label in ("L" * 500, "la\x1fbel", "\x1e" + "m" * 80):
        rows = [(i, f"some words {label} u{i}@mail.example.com end", "", 0) for i in range(20)] + [(99, f"some words {label} handle-7x end", "", 0), (98, f"some words {label}x handle-7y end", "", 0)]
        found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
        start = len(f"some words {label} ")
        assert found[99] == [(start, 0, start + 9)]


def test_rare_patterns_count_in_a_large_corpus(spark):
    """A template that is copied very often does not raise the bar for a rare kind."""
    rows = spark.range(8000).selectExpr("id AS doc_id", "repeat(concat('write to u', id, '@mail.example.com today '), 5) AS text")
    rare = [(10_000 + i, f"my desk line +1 555 010 02{i:02d} rings") for i in range(6)] + [(20_000, "my desk line 7-x-7 rings")]
    docs = rows.unionByName(spark.createDataFrame(rare, "doc_id long, text string"))
    found = pii.extract(docs).filter("doc_id = 20000").first()
    assert [(s.start, s.kind, s.end) for s in found.spans] == [(13, 3, 18)]


def brute_edges(texts, spans_of, rounds=pii.ROUNDS, least=pii.MIN_SEEDS, limit=pii.CONFIDENCE):
    """The accepted (form, kind) by the definition: plain dictionaries over a small corpus, round by round."""
    digit = lambda w: "@" if "@" in w else "".join("0" if c in "0123456789" else c for c in w.lower())
    words = {i: [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}

    def around(i, j, last):
        w = [digit(texts[i][a:b]) for a, b in words[i]]
        found = []
        if j > 0:
            found.append(("before", w[j - 1]))
            if j > 1:
                found.append(("left", w[j - 2], w[j - 1]))
            if last + 1 < len(w):
                found.append(("around", w[j - 1], w[last + 1]))
        return found

    seeds, slots = [], []
    for i, t in texts.items():
        base = spans_of(t)
        for a, k, b in base:
            inside = [j for j, (x, y) in enumerate(words[i]) if x < b and a < y]
            seeds += [(p, k, t[a:b], True) for p in around(i, inside[0], inside[-1])]
        for j, (x, y) in enumerate(words[i]):
            if not any(a < y and x < b for a, _, b in base):
                form = re.search(r"[^\W_][\w.@+:/-]{2,}[^\W_]", t[x:y]) if re.search("[0-9@]", t[x:y]) else None
                slots += [(p, form[0] if form else None) for p in around(i, j, j)]
    accepted, known = set(), {}
    while True:
        forms, sums = collections.defaultdict(set), collections.Counter()
        for p, k, f, _ in seeds:
            forms[p, k].add(f)
            sums[p, k] += 1
        best = {}
        for (p, k), fs in forms.items():
            if len(fs) >= least:
                best[p] = max(best.get(p, (0, 0)), (sums[p, k], -k))
        kinds = {p: -k for p, (_, k) in best.items()}
        if set(kinds) <= set(known):
            return accepted
        known = kinds
        edges = collections.Counter((p, f) for p, f in slots if f and p in kinds)
        total = collections.Counter(p for p, _ in slots)
        own = {p: sum(b and q == p and k == kinds[p] for q, k, _, b in seeds) for p in kinds}
        sure = {e: (e[1], kinds[e[0]]) in accepted for e in edges}
        held = {p: own[p] + sum(n for e, n in edges.items() if e[0] == p and sure[e]) for p in kinds}
        trust = {p: held[p] / (own[p] + total[p] + 1) for p in kinds}
        for number in range(rounds):
            up, down = collections.Counter(), collections.Counter()
            for (p, f), n in edges.items():
                up[f, kinds[p]] += n * trust[p]
                down[f, kinds[p]] += n
            value = {e: 1.0 if sure[e] else up[e[1], kinds[e[0]]] / down[e[1], kinds[e[0]]] for e in edges}
            final = {e: (trust[e[0]], value[e]) for e in edges}
            trust = {p: (held[p] + sum(n * value[e] for e, n in edges.items() if e[0] == p and not sure[e])) / (own[p] + total[p] + 1) for p in kinds}
        fresh = {(e[1], kinds[e[0]]) for e, (c, v) in final.items() if c >= limit and v >= limit} - accepted
        if not fresh:
            return accepted
        accepted |= fresh
        seeds += [(p, k, f, False) for p, f in slots if f for g, k in fresh if g == f]


def planted():
    """Labels that only seeds teach, labels that only found identifiers teach, and words that teach nothing."""
    texts = {}
    for i in range(30):
        texts[i] = f"some words and mail: u{i}@mail{i % 3}.example.com and more {i} words"
        texts[100 + i] = f"call desk +1 555 010 {1000 + i} today or ring the other number"
    for i in range(30):
        texts[200 + i] = f"nothing but mail: handle-{i}x and more words"
        texts[300 + i] = f"profile handle-{i}x seen here"
    for i in range(4):
        texts[400 + i] = f"profile secret-{i}y seen there"
    for i in range(20):
        texts[500 + i] = f"the words and the room {i}b2 of the house"
    texts[600] = "profile of the house and mail: room 7c7"
    return texts


def test_found_identifiers_teach_further_patterns(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], SCHEMA)
    want = brute_edges(texts, base_spans)
    assert {f for f, _ in want} == {f"handle-{i}x" for i in range(30)} | {f"secret-{i}y" for i in range(4)}
    keyed = docs.selectExpr("doc_id", "xxhash64(text) AS text_key", "text")
    seeds = pii.find_base(keyed).selectExpr("explode(seeds) AS s").selectExpr("s.*", "true AS base")
    good, _ = pii.discover(keyed, seeds)
    assert {(r.form, r.kind) for r in good.collect()} == want
    # Precision and recall of the added spans on the planted identifiers.
    added = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s not in r.base] for r in pii.extract(docs).collect()}
    assert {i: x for i, x in added.items() if x} == {200 + i: [f"handle-{i}x"] for i in range(30)} | {300 + i: [f"handle-{i}x"] for i in range(30)} | {400 + i: [f"secret-{i}y"] for i in range(4)}
