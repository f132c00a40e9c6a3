"""Transaction files."""
