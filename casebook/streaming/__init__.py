"""Structured Streaming: continuous ingest and online sequence detection."""
