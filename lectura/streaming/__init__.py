"""Incremental forms of ingest, deduplication and reading activity."""
