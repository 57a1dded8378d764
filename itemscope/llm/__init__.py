"""Operators for building training corpora: counting, cleaning, deduplication, scoring, packing."""
