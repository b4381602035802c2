"""Streaming forms of the log-like parts: metric logs, deduplication of new rows, incremental evaluation."""
