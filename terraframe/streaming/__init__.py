"""Incremental scene processing with Structured Streaming."""
