"""Structured Streaming forms of the governance operators."""
