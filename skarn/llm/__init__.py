"""Training-data operators: token output, counts, packing, filters, near-duplicates, media."""
