"""Dictionary pages in wikitext: pronunciations, definitions and examples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.functions.text import decode_entities, ipa_accent, strip_markup
from lexengine.functions.wikitext import header, joined_lines, read

PAGE_SCHEMA = "title string, revision struct<text struct<_VALUE: string, _bytes: long>>"

# Headers that hold no definitions.
OTHER_HEADERS = frozenset(
    ("etymology", "pronunciation", "references", "anagrams", "alternative", "usage", "derived", "related", "see", "translations",
     "further", "synonyms", "antonyms", "hyponyms", "hypernyms", "coordinate", "meronyms", "holonyms")
)
MIN_DEFINITION, MIN_EXAMPLE, MAX_EXAMPLES = 3, 6, 3

def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of an XML dump, compressed or not.

    A record ends with the tag that closes a page, which a text file can be split by, so large files are read in parallel; Spark's reader of XML takes each file whole.
    """
    records = spark.read.option("lineSep", "</page>").text(path)
    opened = F.regexp_extract("value", r"(?s)<page[\s>].*", 0)
    # Exploded, so that a page is not parsed once for its title and once for its text.
    pages = records.select(F.explode(F.array(opened)).alias("page")).filter("page <> ''")
    pages = pages.select(F.explode(F.array(F.from_xml(F.concat("page", F.lit("</page>")), PAGE_SCHEMA))).alias("p"))
    return pages.select("p.title", F.col("p.revision.text._VALUE").alias("text"))


def english(text: str) -> list[str]:
    """The lines of the English section of a page."""
    lines = text.split("\n")
    inside: list[str] | None = None
    for line in lines:
        found = header(line)
        if found and found[0] == 2:
            if inside is not None:
                break
            if found[1] == "English":
                inside = []
        elif inside is not None:
            inside.append(line)
    return inside or []


def sections(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    """(part of speech, lines) of each header of one capitalised word that holds definitions."""
    pos, held = None, []
    for line in [*lines, "===end==="]:
        found = header(line)
        if not found:
            held.append(line)
            continue
        if pos:
            yield pos, held
        title = found[1]
        pos, held = title.lower() if title.isascii() and title.isalpha() and title.istitle() and title.lower() not in OTHER_HEADERS else None, []


def _item(line: str) -> tuple[str, str]:
    """The marks at the beginning of a list line, and the rest of it."""
    rest = line.lstrip("#:*")
    return line[: len(line) - len(rest)], rest


def senses(lines: list[str]) -> list[dict]:
    """Definitions with their examples, templates resolved.

    A definition stands behind one or two number signs and a blank; below it, examples are list lines that hold a usage or a quotation.
    Whether a definition is long enough is known after cleaning only; so every definition line starts a sense, and
    examples of one that is dropped later go with it.
    """
    found: list[dict] = []
    for pos, content in sections(lines):
        sense = None
        for line in joined_lines(content):
            marks, rest = _item(line)
            if marks in ("#", "##") and rest[:1].isspace() and len(_item(rest.lstrip())[1]) > 1 and not _item(rest.lstrip())[0]:
                sense = {"pos": pos, "text": read(rest.strip()).text, "examples": []}
                found.append(sense)
            elif sense is not None and marks[:1] == "#" and marks.strip("#") and any(name == "ux" or name.startswith("quote-") for name in _names(rest)):
                sense["examples"].append(read(rest.strip()).text)
    return found


def _names(text: str) -> Iterator[str]:
    """What follows each pair of opening braces, up to a bar or the end of the template; the template may be cut off."""
    for part in text.split("{{")[1:]:
        yield part.split("|")[0].split("}}")[0].strip()


def sounds(lines: list[str]) -> list[dict]:
    """Accent and transcription, between slashes, of each English pronunciation template."""
    found: list[dict] = []
    text = "\n".join(lines)
    # What a template leaves has no slash that the page has not.
    if text.count("/") < 2:
        return found
    for name, *rest in read(text).templates:
        if name.strip() == "IPA" and rest and rest[0].strip() == "en":
            said = "|".join(rest[1:])
            parts = said.split("/")
            if len(parts) > 2 and any(parts[1:-1]):
                ipa = next(p for p in parts[1:-1] if p)
                found.append({"said": said, "ipa": f"/{ipa}/"})
    return found


_FOUND = pa.schema([
    ("title", pa.string()),
    ("senses", pa.list_(pa.struct([("pos", pa.string()), ("text", pa.string()), ("examples", pa.list_(pa.string()))]))),
    ("sounds", pa.list_(pa.struct([("said", pa.string()), ("ipa", pa.string())]))),
])


def parse(pages: DataFrame) -> DataFrame:
    """(word, pronunciations, definitions) of pages (title, text).

    Titles with a colon, or with a blank but no hyphen, are no words (F11); pages without an English
    section or without definitions are dropped. Pages whose titles differ in case only are merged:
    definitions are appended, pronunciations are distinct (A12). Of the short definitions that the
    cleaning leaves none repeats its predecessor (Q7).
    """
    rows = pages.filter(~F.col("title").contains(":") & (~F.col("title").contains(" ") | F.col("title").contains("-")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [english(t or "") for t in batch.column(1).to_pylist()]
            own = {"title": batch.column(0), "senses": [senses(x) for x in lines], "sounds": [sounds(x) for x in lines]}
            yield pa.RecordBatch.from_pydict(own, schema=_FOUND)

    types = "title string, senses array<struct<pos:string,text:string,examples:array<string>>>, sounds array<struct<said:string,ipa:string>>"
    # Pages cost far more than their bytes tell, so a table of one small file is dealt out to all tasks; given a number, Spark does not put small parts together again.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("title", "text").repartition(parts, "title").mapInArrow(found, types)
    clean = lambda c: strip_markup(decode_entities(c))
    examples = lambda s: F.slice(F.filter(F.transform(s.examples, clean), lambda e: (F.length(e) >= MIN_EXAMPLE) & ~e.contains("{{")), 1, MAX_EXAMPLES)
    definitions = F.filter(
        F.transform("senses", lambda s: F.struct(s.pos.alias("pos"), clean(s.text).alias("definition_en"), F.transform(examples(s), lambda e: F.struct(e.alias("en"))).alias("examples"))),
        lambda d: F.length(d.definition_en) >= MIN_DEFINITION,
    )
    ipa = F.transform("sounds", lambda p: F.struct(ipa_accent(p.said).alias("accent"), p.ipa.alias("ipa")))
    # Exploded, so that pages are not cleaned once for the filter and once for their definitions.
    rows = rows.select("title", F.explode(F.array(F.struct(definitions.alias("definitions"), ipa.alias("pronunciations")))).alias("p"))
    rows = rows.select(F.lower("title").alias("word"), "title", "p.definitions", "p.pronunciations").filter("size(definitions) > 0")
    merged = rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("title", "definitions", "pronunciations"))).alias("pages"))
    return merged.select("word", F.array_distinct(F.flatten("pages.pronunciations")).alias("pronunciations"), F.flatten("pages.definitions").alias("definitions"))
