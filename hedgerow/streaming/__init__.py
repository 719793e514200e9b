"""Structured Streaming forms of the stateful operators; each has a batch twin in ``operators``."""
