"""Corpus, lexicon and recognition analytics as PySpark DataFrame operators."""
