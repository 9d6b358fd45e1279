"""Structured Streaming forms of ingest and question answering."""
