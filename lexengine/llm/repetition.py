"""Quality rules with suffix-array repetition.

The texts of a batch share one suffix array over their words, sorted by text first, so that only suffixes of the same
text are neighbours. It is built by doubling: words have ranks, then pairs of words, then four, and only suffixes that
still share their rank are sorted again. The ranks of all rounds give the longest common prefix (LCP) of neighbours by
binary descent. Neighbours whose LCP is at least some length form LCP intervals; an interval whose suffixes
follow different words is a maximal repeat. Each suffix starts its longest repeat, that of the deepest interval
that holds it, so the union of all repeats is the union of those spans.

A text fails if maximal repeats cover too much of it, or if one is too long. Beside that stand plain rules: too few
words, and too many words in windows of five that occur again.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import WORD, in_arrow, table

#: Words of a window of the plain rule; a text needs so many words, and at most this percentage of them in repeated windows.
WINDOW, FEWEST_WORDS, WINDOW_PERCENT = 5, 10, 20
#: Repeats of fewer words do not count; those that count cover at most this percentage of a text's word characters, and none is longer than so many words.
LEAST, COVERED_PERCENT, LONGEST = 10, 20, 50
#: Words whose suffixes are sorted together; a text with more comes alone.
TOGETHER = 400_000

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_WORD = re.compile(WORD)


class SuffixArray:
    """Suffixes of the texts in ids, text by text; ends says where each text ends. No text is compared beyond its end."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = self.n = len(ids)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        stop = ends[text]
        key = text * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key)
        first = np.r_[True, np.diff(key[order]) != 0][:n]
        rank = np.zeros(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        #: ranks[j] ranks suffixes by their first 2^j words; a suffix that shares its rank with none keeps it.
        self.ranks = [rank.astype(np.int32)]
        open_ = order[~(first & np.r_[first[1:], True])] if n else order
        width = 1
        while len(open_):
            after = open_ + width
            inside = after < stop[open_]
            second = np.zeros(len(open_), np.int64)
            second[inside] = rank[after[inside]] + 1
            key = rank[open_] * (n + 1) + second
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            own, at = rank[open_], np.arange(len(open_))
            first = np.r_[True, np.diff(key) != 0]
            group = np.maximum.accumulate(np.where(np.r_[True, np.diff(own) != 0], at, 0))
            rank[open_] = own + np.maximum.accumulate(np.where(first, at, 0)) - group
            self.ranks.append(rank.astype(np.int32))
            open_ = open_[~(first & np.r_[first[1:], True])]
            width *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def lcp(self, least: int) -> np.ndarray:
        """Per place of the order, the words that its suffix shares with the one before; 0 where fewer than least."""
        out = np.zeros(self.n, np.int64)
        level = least.bit_length() - 1
        if level >= len(self.ranks) or self.n < 2:
            return out
        a, b = self.order[:-1], self.order[1:]
        near = np.flatnonzero(self.ranks[level][a] == self.ranks[level][b])
        a, b = a[near], b[near]
        long = np.zeros(len(near), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            # Two suffixes of a text never reach the end of the array together.
            ranks = np.append(self.ranks[j], -1)
            long += np.where(ranks[np.minimum(a + long, self.n)] == ranks[np.minimum(b + long, self.n)], 1 << j, 0)
        out[near + 1] = np.where(long >= least, long, 0)
        return out

    def longest(self, lcp: np.ndarray) -> np.ndarray:
        """Per suffix, by its start, the length of the longest repeat that starts there."""
        out = np.zeros(self.n, np.int64)
        out[self.order] = np.maximum(lcp, np.append(lcp[1:], 0)[: self.n])
        return out


def covered(starts: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """Whether each of n places lies in one of the spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def maximal_repeats(array: SuffixArray, lcp: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(first start, words, times) of each maximal repeat; starts are those of the texts.

    LCP intervals come from a stack of rising prefixes. Words before a repeat all alike, or none at all, mean that it can
    grow to the left, so it is not maximal; the beginning of a text counts as a word of its own.
    """
    before = np.where(np.isin(array.order, starts), -1 - array.order, ids[array.order - 1])
    differs = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    found, places = [], np.flatnonzero(lcp)
    for run in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
        stack: list[tuple[int, int]] = []
        for k, here in [*zip(run.tolist(), lcp[run].tolist(), strict=True), (int(run[-1]) + 1, 0)] if len(run) else []:
            left = k - 1
            while stack and stack[-1][0] > here:
                size, left = stack.pop()
                if differs[k - 1] > differs[left]:
                    found.append((int(array.order[left:k].min()), size, k - left))
            if here and (not stack or stack[-1][0] < here):
                stack.append((here, left))
    return found


_FOUND = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "covered_words": pa.int64(), "covered_chars": pa.int64(), "longest_repeat": pa.int64(),
    "repeats": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("times", pa.int64())])),
}
_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, covered_chars long, longest_repeat long, repeats array<struct<start:bigint,end:bigint,times:bigint>>"


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def _measured(texts: list[str], words: list[list[bytes]], least: int, spans: bool) -> dict[str, list]:
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for own in words for w in own), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends, starts = np.cumsum(sizes), np.cumsum(sizes) - sizes
    array = SuffixArray(ids, ends)
    lcp = array.lcp(min(least, WINDOW))
    longest = array.longest(lcp)
    again = covered(np.flatnonzero(longest >= WINDOW), WINDOW, array.n)
    longest[longest < least] = 0
    begin = np.flatnonzero(longest)
    inside = covered(begin, longest[begin], array.n)
    chars = np.zeros(array.n, np.int64)
    if inside.any():
        chars[inside] = np.array([len(w.decode()) for w in number], np.int64)[ids[inside]]
    # Sums per text from running totals, as texts may be empty.
    per_text = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]]).tolist()
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, np.searchsorted(ends, begin, side="right"), longest[begin])
    repeats: list[list[dict]] = [[] for _ in texts]
    if spans and len(begin):
        places: dict[int, list[tuple[int, int]]] = {}
        for start, size, times in sorted(maximal_repeats(array, np.where(lcp >= least, lcp, 0), ids, starts)):
            i = int(np.searchsorted(ends, start, side="right"))
            if i not in places:
                places[i] = [m.span() for m in _WORD.finditer(texts[i])]
            at = start - int(starts[i])
            repeats[i].append({"start": places[i][at][0], "end": places[i][at + size - 1][1], "times": times})
    return {
        "n_words": sizes.tolist(), "word_chars": [len(t) - sum(map(t.count, _SPACES)) for t in texts], "n_symbols": [sum(map(t.count, _SYMBOLS)) for t in texts],
        "n_dup_lines": [dup_lines(t) for t in texts], "n_repeat_words": per_text(again), "covered_words": per_text(inside), "covered_chars": per_text(chars),
        "longest_repeat": most.tolist(), "repeats": repeats,
    }


def measure(docs: DataFrame, least: int = LEAST, spans: bool = True) -> DataFrame:
    """docs with what _FOUND names: counts, what maximal repeats of at least so many words cover, and those repeats.

    repeats holds, by start, the first place of each maximal repeat (code points, end exclusive) and how often it occurs;
    without spans it stays empty. Whole texts are measured. Null texts count as empty and have zeros and no repeats. Rows that repeat are measured
    each; an empty table gives no rows. Columns of docs with a name of _FOUND give way; others, and null ids, stay as they are.
    """
    docs = docs.select(*[c for c in docs.columns if c not in _FOUND])
    kept = list(docs.columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, text_column = 0, batch.schema.get_field_index("text")
            while at < batch.num_rows:
                texts, words, held = [], [], 0
                while at + len(texts) < batch.num_rows and (not texts or held < TOGETHER):
                    texts.append(batch.column(text_column)[at + len(texts)].as_py() or "")
                    # The white space of bytes is that of the contract's words; of str it is not.
                    words.append(texts[-1].encode().split())
                    held += len(words[-1])
                found = _measured(texts, words, least, spans)
                own = [pa.array(found[n], kind) for n, kind in _FOUND.items()]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, *own], names=[*kept, *_FOUND])
                at += len(texts)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_arrow(docs, rows, f"{types}, {_TYPES}")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_PERCENT * F.col("n_words"))


def too_repetitive(percent: int = COVERED_PERCENT, longest: int = LONGEST) -> Column:
    return (100 * F.col("covered_chars") > percent * F.col("word_chars")) | (F.col("longest_repeat") > longest)


def judge(docs: DataFrame, least: int = LEAST, percent: int = COVERED_PERCENT, longest: int = LONGEST, spans: bool = False) -> DataFrame:
    """measure() with base_failed and kept: false if a plain rule fails or repeats cover too much or are too long.

    Texts without words fail the plain rules. Columns of docs named base_failed or kept give way.
    """
    found = measure(docs.select(*[c for c in docs.columns if c not in ("base_failed", "kept")]), least, spans)
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~too_repetitive(percent, longest))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "covered_chars")


def _windows_sql(size: int) -> str:
    """Per word of a text whether it lies in a window of size words that occurs twice or more in the text."""
    return f"""
    SELECT doc, i, max(CASE WHEN times > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS again
    FROM (SELECT doc, i, CASE WHEN full_window THEN count(*) OVER (PARTITION BY doc, gram) ELSE 0 END AS times
          FROM (SELECT doc, i, i + {size - 1} <= n AS full_window, CASE WHEN i + {size - 1} <= n THEN array_to_string(ws[i:i + {size - 1}], ' ') END AS gram FROM words))"""


# A word is covered by repeats of at least LEAST words if it lies in a repeated window of LEAST words, and a repeat is longer
# than LONGEST words if a window of one word more is repeated.
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS lines FROM docs),
words AS (SELECT doc, ws, len(ws) AS n, unnest(generate_series(1, len(ws))) AS i FROM split),
five AS ({_windows_sql(WINDOW)}),
cover AS ({_windows_sql(LEAST)}),
long AS ({_windows_sql(LONGEST + 1)}),
marks AS (
  SELECT doc, sum(five.again) AS n_repeat_words, sum(cover.again) AS covered_words, sum(cover.again * length(ws[i])) AS covered_chars, max(long.again) AS too_long
  FROM words JOIN five USING (doc, i) JOIN cover USING (doc, i) JOIN long USING (doc, i) GROUP BY doc),
counted AS (
  SELECT doc, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines
  FROM split),
ruled AS (
  SELECT counted.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_words, 0)::BIGINT AS covered_words, coalesce(covered_chars, 0)::BIGINT AS covered_chars, coalesce(too_long, 0) AS too_long
  FROM counted LEFT JOIN marks USING (doc))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, covered_chars,
       n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {WINDOW_PERCENT} * n_words AS base_failed,
       NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {WINDOW_PERCENT} * n_words OR 100 * covered_chars > {COVERED_PERCENT} * word_chars OR too_long = 1) AS kept
FROM ruled
"""
