"""Structured Streaming versions of the cycle and of the keyed signals."""
