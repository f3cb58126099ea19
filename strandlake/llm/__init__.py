"""Training-data operators: deduplication, sharding, scans, archives, models, packing and filters."""
