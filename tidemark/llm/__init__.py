"""Training-data operators: near-duplicate joins, scans, filters, counting, mixing and packing of text corpora."""
