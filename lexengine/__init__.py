"""Lexical analytics on Spark: ingestion, classification, search and maintenance of a lexicon."""
