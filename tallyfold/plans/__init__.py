"""The four end-to-end questions: clean, describe, segment, forecast."""
