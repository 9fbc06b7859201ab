"""Training-data operators: deduplication, filtering, scoring, packing and counting of text."""
