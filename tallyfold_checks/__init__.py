"""The library's operators over the test tables, each beside the same thing in SQL."""
