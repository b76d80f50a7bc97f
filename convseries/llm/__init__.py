"""Operators for large text corpora: filtering, deduplication, mixing, packing and token files."""
