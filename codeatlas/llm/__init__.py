"""Operators for preparing large text corpora: scoring, filtering, deduplication and mixing."""
