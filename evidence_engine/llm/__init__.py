"""Training-data operators: cleaning, deduplication, scoring and packing of large text corpora."""
