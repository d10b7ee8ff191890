"""Streaming variants of the point-in-time operators."""
