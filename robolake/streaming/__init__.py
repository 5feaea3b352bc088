"""Structured Streaming forms of windows, sessions, interval joins, deduplication and keyed state."""
