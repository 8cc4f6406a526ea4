"""Structured Streaming forms of the incremental scan and its progress counters."""
