"""Training-data operators: packing, tokenisation, search, deduplication, classification."""
