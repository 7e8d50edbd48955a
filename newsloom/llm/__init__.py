"""Training-data operators for matching, deduplication and text."""
