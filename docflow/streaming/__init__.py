"""Incremental ingest with Structured Streaming (an extension)."""
