"""Incremental ingest of page images and records."""
