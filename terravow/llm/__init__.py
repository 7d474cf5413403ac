"""Training-data operators: deduplication, filtering, labelling, counting and packing."""
