"""Schemas, table scans and sinks, JSON rows, and role frames over star-schema tables."""
