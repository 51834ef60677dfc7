"""Training-data operators: extraction, scoring, scanning, deduplication, mixing and sharding."""
