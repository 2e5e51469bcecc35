"""Training-data operators: packing, near-duplicate joins, extraction, encoding, search, sharding and filtering."""
