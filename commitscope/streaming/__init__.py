"""Structured Streaming variants of the batch jobs (OP-25, OP-30, OP-31, OP-40)."""
