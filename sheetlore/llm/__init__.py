"""Operators for preparing text corpora: counting, deduplication, filtering, tokenisation and materialisation."""
