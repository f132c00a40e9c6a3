"""Errors raised by the library."""


class InvalidDataset(ValueError):
    """The input table cannot answer the question asked of it."""
