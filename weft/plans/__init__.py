"""Saved datasets and incremental runs."""
