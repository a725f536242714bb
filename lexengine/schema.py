"""Schemas of the lexicon, in DDL: one table per entity, and the nested record of one entry."""

from __future__ import annotations

SCHEMAS = {
    "words": "id bigint, word string, language string, word_normalized string, frequency_rank int, part_of_speech array<string>",
    "definitions": "id bigint, word_id bigint, part_of_speech string, definition_en string, definition_vi string, level string, definition_order int",
    "examples": "id bigint, definition_id bigint, example_en string, example_vi string, source string",
    "pronunciations": "id bigint, word_id bigint, accent string, ipa string, audio_url string",
    "synonyms": "id bigint, word_id bigint, synonym_word string, similarity_score decimal(3,2)",
    "word_forms": "id bigint, word_id bigint, form_type string, form_word string",
    "categories": "id bigint, name string, display_name string, description string, icon string, topic string, display_order int, parent_id bigint",
    "category_words": "id bigint, category_id bigint, word_id bigint, display_order int",
    "word_lists": "id string, user_id string, word string, notes string",
}

#: One entry as the corpora are merged into and as JSON files hold it.
ENTRY = (
    "word string, word_normalized string, language string, frequency_rank int, "
    "pronunciations array<struct<accent string, ipa string>>, "
    "definitions array<struct<pos string, definition_en string, level string, examples array<struct<en string, vi string>>>>, "
    "synonyms array<string>, word_forms map<string,string>"
)
