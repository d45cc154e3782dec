"""Incremental runs of batch jobs."""
