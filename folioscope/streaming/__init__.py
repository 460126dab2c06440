"""Streaming additions: append-only ingestion of page documents with idempotent ids."""
