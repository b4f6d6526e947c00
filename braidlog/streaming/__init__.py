"""Streaming ingestion of operation logs."""
