"""Operators that prepare text and media corpora for model training."""
