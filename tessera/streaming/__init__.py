"""Append-only logs with consumer groups, in batch and as Structured Streaming."""
