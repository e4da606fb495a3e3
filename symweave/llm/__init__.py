"""Training-data operators: formatting, deduplication, search, tokenising, filtering and extraction."""
