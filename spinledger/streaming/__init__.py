"""Structured Streaming forms of the event-at-a-time behaviour."""
