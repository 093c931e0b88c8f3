"""Training-data operators: deduplication, mixing, extraction, formatting, sharding, scoring."""
