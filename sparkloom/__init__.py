"""Corpus analytics on Spark: text, links, terms, duplicates and questions as DataFrame plans."""
