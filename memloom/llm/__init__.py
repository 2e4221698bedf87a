"""Training-data operators: scoring, formatting, packing, deduplication, scanning, counting."""
