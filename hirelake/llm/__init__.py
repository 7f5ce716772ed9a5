"""Training-data operators: near-dedup, quality, sharding, extraction, scoring, WARC, language, tokens."""
