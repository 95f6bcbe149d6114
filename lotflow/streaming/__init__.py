"""Structured Streaming jobs: the batch operators applied per micro-batch."""
