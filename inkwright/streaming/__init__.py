"""Structured Streaming forms of the neighbour rules and of completion."""
