"""Training-data operators: sharding, quality, dedup, decontamination, extraction, tokenising."""
