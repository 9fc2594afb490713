"""Operators for large text corpora: language, quality, toxicity, duplicates, URLs, mixing and token totals."""
