"""Structured Streaming entry points (append-only intake)."""
