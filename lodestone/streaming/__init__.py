"""Structured Streaming: ingestion by micro-batches, and a cache whose entries expire."""
