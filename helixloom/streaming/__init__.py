"""Structured Streaming twins of the batch operators; the oracle of each is its batch result."""
