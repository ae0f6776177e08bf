"""Training-data operators: language, quality, secrets, extraction, sharding, duplicates, leaks, fingerprints and tokens."""
