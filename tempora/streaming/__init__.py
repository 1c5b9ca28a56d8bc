"""Structured Streaming: ingest, archive, broadcast."""
