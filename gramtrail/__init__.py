"""Positional text search on Spark: phrases, typos and questions answered with exact token positions."""

from .operators.corpus import Corpus

__all__ = ["Corpus"]
