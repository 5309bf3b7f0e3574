"""Readers for pages, crawl logs and files, and the sinks that take records and outbox rows."""
