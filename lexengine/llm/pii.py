"""Personal data by bootstrapped contextual extraction.

Seeds are entities of four kinds that fixed patterns find. The words around a seed induce lexical
patterns: its left word, its two left words, and its left and right word; in these words digits count as one digit and
words with an @ as one word. Spark counts how often each pattern occurs in the
whole corpus and which identifier-like tokens it holds, and scores the graph of patterns and
instances iteratively: a pattern is as good as the instances in its slot, an instance as good as the
patterns that hold it. Instances that patterns of high confidence hold are found anew; they become seeds in their turn:
the contexts of all their places induce further patterns, until no instance is new. What was found becomes spans of
the pattern's kind, beside the base spans, which all stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import in_arrow, join_hot, stored, table

KINDS = ("email", "ip", "card", "phone")
#: A pattern must surround so many different seeds.
MIN_SEEDS = 3
#: Bits, for each word and at most, of the filters through which tasks know patterns and forms; what they let through wrongly, a join drops.
BITS_PER_WORD, MOST_BITS = 16, 1 << 28
#: Sums and words that a task holds.
HELD = 200_000
#: Patterns and instances at or above are accepted; patterns are scored so many times.
CONFIDENCE, ROUNDS = 0.8, 3
#: Longer words stand in contexts by their digest, so that a pattern has a bounded size.
MAX_CONTEXT = 64

# Fixed forms of the base kinds. Lookbehinds and possessive runs only keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: White space that str.split() knows and the tokens do not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: An identifier-like token holds a digit or an at sign; marks around it are not part of it.
_IDENTIFIER = re.compile(r"[^\W_][\w.@+:/-]{2,}[^\W_]")


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds just one @; its name is the whole run before that, down to the last match."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            found.append((start, domain.end()))
            free = domain.end()
        # Without a match, the part before this @ cannot belong to a later one either.
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, sorted; code points, end exclusive."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _lexical(word: str) -> str:
    """A word of a context, in lower case, with digits alike; very long words, and those with the mark between words, by their digest."""
    if "@" in word:
        return "@"
    word = _DIGIT.sub("0", word.lower())
    return "\x1e" + hashlib.sha256(word.encode()).hexdigest() if len(word) > MAX_CONTEXT or "\x1f" in word else word


def contexts(left: list[str], right: str | None) -> list[str]:
    """The patterns of a slot: its left word, its two left words, and its left and right word."""
    near = [_lexical(w) for w in left]
    found = []
    if near:
        found.append("\x1f".join(("before", near[-1])))
        if len(near) == 2:
            found.append("\x1f".join(("left", *near)))
        if right is not None:
            found.append("\x1f".join(("around", near[-1], _lexical(right))))
    return found


def _words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _slot(text: str, words: list[tuple[int, int]], first: int, last: int) -> list[str]:
    """Patterns around the words first..last."""
    left = [text[a:b] for a, b in words[max(0, first - 2) : first]]
    right = text[words[last + 1][0] : words[last + 1][1]] if last + 1 < len(words) else None
    return contexts(left, right)


def _inside(starts: list[int], start: int, end: int) -> tuple[int, int]:
    """Numbers of the first and last word that a span touches; starts are those of the words."""
    return bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text) if _ODD_SPACE.search(text) else text.split()


def find_base(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, base spans and the patterns and forms of its seeds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seeds = [], []
            for t in batch.column(2):
                text = t.as_py() or ""
                found = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                near = []
                if found:
                    words = _words(text)
                    starts = [a for a, _ in words]
                    for a, k, b in found:
                        near += [{"pattern": p, "kind": k, "form": text[a:b]} for p in _slot(text, words, *_inside(starts, a, b))]
                seeds.append(near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS), pa.array(seeds, _SEEDS)], names=["doc_id", "text_key", "spans", "seeds"])

    return in_arrow(
        docs, rows, "doc_id long, text_key long, spans array<struct<start:int,kind:int,end:int>>, seeds array<struct<pattern:string,kind:int,form:string>>"
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_SEEDS = pa.list_(pa.struct([("pattern", pa.string()), ("kind", pa.int32()), ("form", pa.string())]))
_SLOTS = pa.schema([("pattern", pa.string()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("form", pa.string()), ("times", pa.int64())])


def induce(seeds: DataFrame) -> DataFrame:
    """Patterns (pattern, kind, seeds) that surround enough different seeds, whatever the number of all seeds.

    A pattern that surrounds seeds of several kinds stands for the most frequent of them. The column seeds counts
    base entities alone; instances that were found are counted where their places are scored.
    """
    by_form = seeds.groupBy("pattern", "kind", "form").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("base").cast("int")).alias("seeds"))
    by_kind = by_form.groupBy("pattern", "kind").agg(F.sum("all").alias("all"), F.sum("seeds").alias("seeds"), F.count(F.lit(1)).alias("forms"))
    enough = by_kind.filter(F.col("forms") >= MIN_SEEDS)
    best = enough.groupBy("pattern").agg(F.max(F.struct("all", (-F.col("kind")).alias("kind"), "seeds")).alias("b"))
    return best.select("pattern", (-F.col("b.kind")).alias("kind"), F.col("b.seeds").alias("seeds"))


def text_filter(words: DataFrame) -> np.ndarray:
    """Bits of which each text in the column word sets one; there are BITS_PER_WORD for each row, and MOST_BITS at most."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_PER_WORD * words.count() - 1).bit_length()))
    at = words.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(size)).cast("long").alias("bit"))
    rows = at.groupBy(F.shiftright("bit", 5).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 AS INT))")).alias("bits")).toArrow()
    found = np.zeros(size // 32, np.uint32)
    found[rows["place"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return found


def _holds(bits: bytes, word: str) -> bool:
    at = zlib.crc32(word.encode()) % (8 * len(bits))
    return bool(bits[at >> 3] >> (at & 7) & 1)


def pattern_filter(patterns: DataFrame) -> np.ndarray:
    """Bits for each pattern and, of patterns of two words, for the word to the left of their slot."""
    parts = F.split("pattern", "\x1f")
    word = F.when(parts[0] == "left", parts[2]).when(parts[0] == "around", parts[1])
    return text_filter(patterns.select(F.explode(F.array_compact(F.array("pattern", word))).alias("word")))


class _Base:
    """The base spans of a text, which may overlap each other."""

    def __init__(self, text: str):
        self.text, spans = text, base_spans(text)
        self.starts = [a for a, _, _ in spans]
        #: The last end of all spans so far.
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def identifier(self, start: int, end: int) -> tuple[bool, re.Match | None]:
        """Whether a base span touches a word, and, if none does, the identifier-like token in it."""
        before = bisect_left(self.starts, end)
        if before and self.ends[before - 1] > start:
            return True, None
        return False, _IDENTIFIER.search(self.text, start, end)


def _like_identifiers(text: str, low: list[str]) -> list[int]:
    """Numbers of the words with a digit or an at sign."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    return [j for j, w in enumerate(low) if "@" in w or _DIGIT.search(w)]


def _as_context(text: str, low: list[str], like: list[int]) -> None:
    """Puts what _lexical makes of them in place of lower-cased words: of those with digits or an at sign, and of odd ones."""
    if "\x1f" in text or max(map(len, low), default=0) > MAX_CONTEXT:
        like = {*like, *(j for j, w in enumerate(low) if "\x1f" in w or len(w) > MAX_CONTEXT)}
    for j in like:
        low[j] = _lexical(low[j])


def pattern_slots(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The places of the whole corpus that patterns surround, but for those that base spans touch.

    A slot that holds an identifier-like token is a row with its place and form. Of slots that
    hold any other word only the number counts: those are summed by pattern, in rows without a place.
    Tasks know patterns by a filter, so rows of a few contexts that are no pattern are among them.
    """
    known = docs.sparkSession.sparkContext.broadcast(pattern_filter(patterns).tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value

        @lru_cache(HELD)
        def near(word: str) -> tuple[str | None, bool]:
            """The pattern of a slot behind this word, if there is one, and whether there may be one of two words."""
            before = "\x1f".join(("before", word))
            return before if _holds(bits, before) else None, _holds(bits, word)

        plain: dict[str, int] = {}
        for batch in batches:
            out = {n: [] for n in _SLOTS.names}
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py() or ""
                low = [w.lower() for w in _tokens(text)]
                like = _like_identifiers(text, low)
                _as_context(text, low, like)
                some: dict[str, int] = {}
                double = set()
                for word, n in Counter(low[:-1]).items():
                    before, two = near(word)
                    if before:
                        some[before] = n
                    if two:
                        double.add(word)
                for j, word in enumerate(low[:-1], 1) if double else ():
                    if word in double:
                        for key in (("left", low[j - 2], word) if j > 1 else None, ("around", word, low[j + 1]) if j + 1 < len(low) else None):
                            if key and _holds(bits, pattern := "\x1f".join(key)):
                                some[pattern] = some.get(pattern, 0) + 1
                if some and like:
                    words, base = _words(text), _Base(text)
                    for j in like:
                        touched, form = base.identifier(*words[j])
                        if touched or form:
                            for p in _slot(text, words, j, j):
                                if p in some:
                                    some[p] -= 1
                                    if form:
                                        for n, v in zip(_SLOTS.names, (p, batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), form.start(), form.end(), form[0], 1), strict=True):
                                            out[n].append(v)
                for p, n in some.items():
                    if n:
                        plain[p] = plain.get(p, 0) + n
            yield pa.RecordBatch.from_pydict(out, schema=_SLOTS)
            if len(plain) > HELD:
                yield _sums(plain)
                plain = {}
        yield _sums(plain)

    def _sums(plain: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: list(plain) if n == "pattern" else list(plain.values()) if n == "times" else [None] * len(plain) for n in _SLOTS.names}, schema=_SLOTS)

    return in_arrow(docs, rows, "pattern string, doc_id long, text_key long, start int, end int, form string, times long")


def occurrences(docs: DataFrame, instances: DataFrame) -> DataFrame:
    """(pattern, kind, form, base): the contexts of all places of the corpus that hold an instance (form, kind)."""
    known = docs.sparkSession.sparkContext.broadcast(text_filter(instances.select(F.col("form").alias("word"))).tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str]] = []
            for t in batch.column(0):
                text = t.as_py() or ""
                like = _like_identifiers(text, _tokens(text))
                if like:
                    words, base = _words(text), _Base(text)
                    for j in like:
                        form = base.identifier(*words[j])[1]
                        if form and _holds(known.value, form[0]):
                            found += [(p, form[0]) for p in _slot(text, words, j, j)]
            yield pa.RecordBatch.from_pydict({"pattern": pa.array([p for p, _ in found], pa.string()), "form": pa.array([f for _, f in found], pa.string())})

    held = stored(in_arrow(docs.select("text"), rows, "pattern string, form string"))
    sized = instances.join(held.groupBy("form").agg(F.count(F.lit(1)).alias("n")), "form")
    return join_hot(held, sized, "form", "n", held.count()).select("pattern", "kind", "form", F.lit(False).alias("base"))


def score(patterns: DataFrame, slots: DataFrame, accepted: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The graph of patterns and instances: one row per edge with the confidence of the pattern and the score of the instance.

    A pattern's confidence is the share of its places that hold seeds or, by their scores, good
    instances; an instance's score is the mean confidence of the places that hold it, and 1 if it was accepted
    before. Both sides can be large, and so can the number of edges of one end.
    """
    edges = stored(slots.filter(F.col("form").isNotNull()).groupBy("pattern", "form").agg(F.sum("times").alias("times")).join(patterns.select("pattern", "kind"), "pattern"))
    edges = edges.withColumn("instance", F.struct("form", "kind"))
    if accepted is None:
        edges = edges.withColumn("sure", F.lit(False))
    else:
        sizes = edges.groupBy("instance").agg(F.count(F.lit(1)).alias("edges"))
        sure = sizes.join(accepted.select(F.struct("form", "kind").alias("instance"), F.lit(True).alias("sure")), "instance", "left")
        edges = join_hot(edges, sure, "instance", "edges", edges.count()).drop("edges").withColumn("sure", F.coalesce("sure", F.lit(False)))
    edges = stored(edges)
    rows = edges.count()
    totals = patterns.join(slots.groupBy("pattern").agg(F.sum("times").alias("others")), "pattern", "left")
    counted = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.when(F.col("sure"), F.col("times")).otherwise(0)).alias("surely"))
    totals = totals.join(counted, "pattern", "left").withColumn("held", F.col("seeds") + F.coalesce("surely", F.lit(0)))
    totals = stored(totals.select("pattern", "held", "edges", (F.col("seeds") + F.coalesce("others", F.lit(0)) + 1).alias("places")))
    confidence = totals.select("pattern", "edges", (F.col("held") / F.col("places")).alias("confidence"))
    for number in range(rounds):
        both = stored(join_hot(edges, confidence, "pattern", "edges", rows).drop("edges"))
        forms = both.groupBy("instance").agg((F.sum(F.col("times") * F.col("confidence")) / F.sum("times")).alias("mean"), F.count(F.lit(1)).alias("edges"))
        both = join_hot(both, forms, "instance", "edges", rows).withColumn("score", F.when(F.col("sure"), 1.0).otherwise(F.col("mean")))
        both = stored(both.select("pattern", "form", "kind", "times", "sure", "confidence", "score"))
        if number < rounds - 1:
            more = both.filter(~F.col("sure")).groupBy("pattern").agg(F.sum(F.col("times") * F.col("score")).alias("more"))
            confidence = stored(totals.join(more, "pattern", "left").select("pattern", "edges", ((F.col("held") + F.coalesce("more", F.lit(0.0))) / F.col("places")).alias("confidence")))
    return both


def discover(docs: DataFrame, seeds: DataFrame, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame] | None:
    """The edges (pattern, form, kind, times) that are accepted in the end, and all slots; None if no pattern comes up.

    docs has doc_id, text_key and text, seeds has pattern, kind, form and base. Each round looks for the slots of
    new patterns only, so the corpus is read twice more for every round in which an instance is new.
    """
    known = slots = accepted = good = None
    while True:
        patterns = stored(induce(seeds))
        new = patterns if known is None else patterns.join(known, "pattern", "left_anti")
        if new.isEmpty():
            break
        more = stored(pattern_slots(docs, new))
        slots = more if slots is None else slots.unionByName(more)
        known = patterns.select("pattern") if known is None else known.unionByName(new.select("pattern"))
        edges = score(patterns, slots, accepted)
        good = stored(edges.filter((F.col("confidence") >= confidence) & (F.col("score") >= confidence)))
        fresh = good.filter(~F.col("sure")).select("form", "kind").distinct()
        if accepted is not None:
            fresh = fresh.join(accepted, ["form", "kind"], "left_anti")
        fresh = stored(fresh)
        if fresh.isEmpty():
            break
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        seeds = seeds.unionByName(stored(occurrences(docs, fresh)))
    return None if good is None else (good.select("pattern", "form", "kind", "times"), slots)


def extract(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of docs: doc_id, base and spans, both arrays of (start, kind, end).

    docs needs doc_id and text; other columns are ignored. Null texts count as empty and hold nothing. Rows that repeat are reported each.
    Found spans never overlap base spans; where patterns of several kinds find the same place, the first kind counts.
    An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    base = stored(find_base(docs))
    found = discover(docs, base.select(F.explode("seeds").alias("s")).select("s.*", F.lit(True).alias("base")), confidence)
    if found is None:
        return base.select("doc_id", F.col("spans").alias("base"), "spans")
    good, slots = found
    places = slots.filter(F.col("form").isNotNull()).select(F.struct("pattern", "form").alias("edge"), "doc_id", "text_key", "start", "end")
    found = join_hot(places, good.select(F.struct("pattern", "form").alias("edge"), "kind", "times"), "edge", "times", places.count())
    found = found.groupBy("doc_id", "text_key", "start", "end").agg(F.min("kind").alias("kind"))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    both = base.join(found, base.doc_id.eqNullSafe(found.d) & (base.text_key == found.k), "left")
    return both.select("doc_id", F.col("spans").alias("base"), F.array_sort(F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))).alias("spans"))


def _said(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s.kind)
    # A lambda of two parameters would get the place of a span as its second, even if that had a default.
    counts = [F.size(F.filter(kinds, lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))
