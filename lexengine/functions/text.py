"""Scalar functions of the lexicon as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexengine.functions import wikitext

# White space and regular expressions are ASCII here unless said otherwise.
_EDGES = r"^\s+|\s+$"


def normalize_key(c: Column) -> Column:
    """Lower case without white space at the ends (of any kind, not only blanks)."""
    return F.lower(F.regexp_replace(c, _EDGES, ""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def to_int(c: Column) -> Column:
    """M2: a whole number, null if the text is none."""
    return c.try_cast("bigint")


def merge_maps(left: Column, right: Column) -> Column:
    """M7: the entries of both maps; of a key in both the right one's value counts. A null map counts as empty."""
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_zip_with(left, right, lambda k, x, y: F.coalesce(y, x)))


def collated(c: Column, collation: str = "UNICODE") -> Column:
    """A sort key in the order of a collation; without it texts sort by code point."""
    return F.collate(c, collation)


def any_contains(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """true if the lower-cased text contains one of the keywords; no word boundaries, keywords are not trimmed."""
    return reduce(lambda a, b: a | b, [c.contains(w.lower()) for w in words], F.lit(False))


def level(rank: Column, word: Column) -> Column:
    """Difficulty by frequency rank, else by length."""
    n = F.length(word)
    by_rank = F.when(rank <= 1000, "beginner").when(rank <= 5000, "intermediate").otherwise("advanced")
    by_length = F.when(n <= 5, "beginner").when(n <= 8, "intermediate").otherwise("advanced")
    return F.when(rank > 0, by_rank).otherwise(by_length)


def inflection(form: Column, pos: Column) -> Column:
    """The kind of an inflected form, null where it is not kept."""
    verb = F.when(form.endswith("ed"), "past").when(form.endswith("ing"), "present_participle").when(form.endswith("s"), "third_person")
    adjective = F.when(form.endswith("er"), "comparative").when(form.endswith("est"), "superlative")
    return F.when(pos == "noun", "plural").when(pos == "verb", verb).when(pos == "adj", adjective)


# Phones of the pronouncing dictionary and their IPA symbols.
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɝ", "EY": "eɪ", "IH": "ɪ",
    "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u",
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l",
    "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "V": "v",
    "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
STRESS = {"1": "ˈ", "2": "ˌ"}


def arpabet_to_ipa(phones: Column) -> Column:
    """Phones, separated by white space, in IPA between slashes; stress marks stand before the vowel, unknown phones are skipped."""
    symbols = F.create_map(*[F.lit(x) for pair in ARPABET.items() for x in pair])
    stress = F.create_map(*[F.lit(x) for pair in STRESS.items() for x in pair])

    def one(phone: Column) -> Column:
        symbol = F.try_element_at(symbols, F.regexp_replace(phone, "[0-2]$", ""))
        mark = F.coalesce(F.try_element_at(stress, F.regexp_extract(phone, "([0-2])$", 1)), F.lit(""))
        return F.when(symbol.isNull(), "").otherwise(F.concat(mark, symbol))

    return F.concat(F.lit("/"), F.array_join(F.transform(F.split(strip(phones), r"\s+"), one), ""), F.lit("/"))


def ipa_accent(content: Column) -> Column:
    """UK if the template says so, else US."""
    return F.when(content.contains("UK") | content.contains("RP") | content.contains("British"), "UK").otherwise("US")


def audio_accent(url: Column) -> Column:
    """The accent that a recording's address tells, or null."""
    return F.when(url.contains("-us.mp3") | url.contains("/us/"), "us").when(url.contains("-uk.mp3") | url.contains("/uk/"), "uk")


def preferred_audio(us: Column, uk: Column, wanted: str) -> Column:
    """The wanted accent, else the other one."""
    return F.coalesce(us, uk) if wanted.upper() == "US" else F.coalesce(uk, us)


def decode_entities(c: Column) -> Column:
    """X11: the ampersand comes first, so what it uncovers is decoded as well."""
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def strip_markup(c: Column) -> Column:
    """Tags and quote runs go, white space collapses. References keep their contents, as their tags went before."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    c = F.regexp_replace(c, "'{2,5}", "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_wikitext(c: Column) -> Column:
    """Wikitext without markup."""
    return strip_markup(decode_entities(wikitext.resolved(c)))


# Codes and names of languages.
LANGUAGES = {
    "en": "English", "vi": "Vietnamese", "zh-cn": "Chinese", "es": "Spanish", "hi": "Hindi", "bn": "Bengali",
    "pt": "Portuguese", "ru": "Russian", "ja": "Japanese", "ko": "Korean", "fr": "French",
}


def language_name(code: Column) -> Column:
    """The language's name, or the code itself."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def json_in_prose(c: Column) -> Column:
    """M9: from the first brace to the last one; empty if there is none."""
    return F.regexp_extract(c, r"(\{[\s\S]*\})", 1)


def sentences(c: Column, n: int) -> Column:
    """The first n lines with more than 10 characters, trimmed."""
    return F.slice(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.length(x) > 10), 1, n)


def percent(part: Column, whole: Column) -> Column:
    """M3: a share in percent, to one decimal; null of nothing."""
    return F.round(F.try_divide(part * 100.0, whole), 1)
