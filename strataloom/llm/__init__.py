"""Training-data operators: scoring, deduplication, packing, sharding and media columns."""
