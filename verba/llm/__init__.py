"""Training-data operators: extraction, formatting, deduplication, mixing, filtering, sharding and packing."""
