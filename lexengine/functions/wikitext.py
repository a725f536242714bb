"""Wikitext: templates and links are read by their braces and bars, and resolved from the inside out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARK = re.compile(r"(\{\{|\}\}|\[\[|\]\]|\|)")
_OPENS = {"}}": "{{", "]]": "[["}


@dataclass
class _Open:
    """A template or link that is being read: how it began, and its arguments so far as pieces of text."""

    mark: str
    arguments: list[list[str]]

    def values(self) -> list[str]:
        return ["".join(a) for a in self.arguments]


def _named(values: list[str], name: str) -> str:
    """A named argument; arguments without a name that follow it belong to it."""
    for i, v in enumerate(values):
        if v.strip().startswith(f"{name}="):
            more = []
            for w in values[i + 1 :]:
                if w.partition("=")[1] and w.partition("=")[0].strip().isidentifier():
                    break
                more.append(w)
            return "|".join([v.partition("=")[2], *more]).strip()
    return ""


def template(values: list[str]) -> str:
    """What stays of a template: labels in brackets, glosses, names of linked pages, examples and quoted passages; of any other nothing."""
    name, rest = values[0].strip(), values[1:]
    if name.startswith("quote-"):
        return _named(rest, "passage") or _named(rest, "text")
    if name in ("lb", "ux"):
        # The language comes first.
        said = "|".join(rest[1:])
        return said if name == "ux" or not said else f"({said})"
    if name == "context":
        return f"({'|'.join(rest)})" if rest else ""
    if name in ("defn", "gloss"):
        return "|".join(rest)
    if name == "w":
        return "|".join(rest[1:] or rest)
    return ""


def link(values: list[str]) -> str:
    """The label of a link, or else the page that it leads to."""
    return "|".join(values[1:]) or values[0]


@dataclass(frozen=True)
class Wikitext:
    """A text without templates and links, and all templates that it held, inner ones first: name and arguments."""

    text: str
    templates: list[list[str]]


def read(text: str) -> Wikitext:
    """Reads a text once, whatever the depth of its templates.

    Marks that close nothing, and those that are never closed, stay as they are; but a quotation that is never closed
    takes all that follows with it.
    """
    if "{{" not in text and "[[" not in text:
        return Wikitext(text, [])
    found: list[list[str]] = []
    stack, open_ = [_Open("", [[]])], {"": 0, "{{": 0, "[[": 0}

    def as_text() -> None:
        top = stack.pop()
        open_[top.mark] -= 1
        stack[-1].arguments[-1].append(top.mark + "|".join(top.values()))

    for part in _MARK.split(text):
        if part in ("{{", "[["):
            stack.append(_Open(part, [[]]))
            open_[part] += 1
        elif part == "|" and len(stack) > 1:
            stack[-1].arguments.append([])
        elif part in _OPENS and open_[_OPENS[part]]:
            while stack[-1].mark != _OPENS[part]:
                as_text()
            top = stack.pop()
            open_[top.mark] -= 1
            values = top.values()
            if top.mark == "{{":
                found.append(values)
            stack[-1].arguments[-1].append(template(values) if top.mark == "{{" else link(values))
        else:
            stack[-1].arguments[-1].append(part)
    lost = next((i for i, o in enumerate(stack) if o.mark == "{{" and o.values()[0].strip().startswith("quote-")), None)
    if lost is not None:
        del stack[lost:]
    while len(stack) > 1:
        as_text()
    plain = stack[0].values()[0]
    return Wikitext(plain.strip() if lost is not None else plain, found)


@F.arrow_udf(StringType())
def resolved(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A column of wikitext without templates and links; nesting is beyond regular expressions, so this is Python, batch by batch."""
    for part in texts:
        yield pa.array([None if t is None else read(t).text for t in part.to_pylist()], pa.string())


def joined_lines(lines: list[str]) -> Iterator[str]:
    """Lines, each with the next ones as long as it opens more templates than it closes."""
    held, depth = [], 0
    for line in lines:
        held.append(line.strip() if held else line)
        depth += line.count("{{") - line.count("}}")
        if depth <= 0:
            yield " ".join(held)
            held, depth = [], 0
    if held:
        yield " ".join(held)


def header(line: str) -> tuple[int, str] | None:
    """Level and title of a header line: as many equals signs before the title as behind it, two at least."""
    if "==" not in line:
        return None
    line = line.strip()
    level = min(len(line) - len(line.lstrip("=")), len(line) - len(line.rstrip("=")))
    title = line[level : len(line) - level].strip()
    return (level, title) if level >= 2 and title else None
