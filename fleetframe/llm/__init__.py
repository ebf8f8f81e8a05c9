"""Training-data operators: quality, deduplication, decontamination, privacy, scoring, packing, archives, shards."""
