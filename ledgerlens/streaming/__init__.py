"""Structured Streaming: ingestion, keyed state, totals, scoring and sinks."""
