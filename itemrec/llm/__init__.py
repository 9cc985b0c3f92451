"""Training-data operators: sharding, scoring, classification, formatting, tokenising and deduplication."""
