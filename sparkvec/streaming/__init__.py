"""Structured Streaming ingestion of operation logs."""
