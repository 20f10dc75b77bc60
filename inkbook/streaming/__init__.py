"""Structured Streaming ingestion of job exports."""
