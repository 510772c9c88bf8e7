"""Structured Streaming: the job queue and its progress."""
