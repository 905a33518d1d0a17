"""Training-data operators: packing, scans, mixing, dedup, scoring and search on Spark."""
