"""DataFrame operators: extraction, matching, dedup, records, digests, signals, frontiers, state and quality."""
