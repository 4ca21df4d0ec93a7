"""Training-data operators: sharding, mixing, classification, decontamination, extraction, dedup, archives."""
