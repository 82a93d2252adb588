"""Training-data operators: search, near-duplicate joins, language ID, packing and the like."""
