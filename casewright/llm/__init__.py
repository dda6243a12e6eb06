"""Training-data operators: packing, deduplication, tokenisation, archives, scoring and fingerprints."""
