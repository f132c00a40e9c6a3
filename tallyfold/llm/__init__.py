"""Operators for preparing text corpora at scale, one module each."""
