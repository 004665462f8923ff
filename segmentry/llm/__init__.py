"""Training-data operators: scoring, deduplication, mixing, packing and filters for text corpora."""
