"""Operators of a training-data pipeline: quality, language, near copies, tokens, shards, contamination and secrets."""
