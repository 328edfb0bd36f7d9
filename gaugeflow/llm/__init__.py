"""Training-data operators: mixing, sharding, scans, joins, dedup, scoring and formatting of text tables."""
