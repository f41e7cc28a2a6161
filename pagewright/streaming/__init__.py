"""Structured Streaming adapters."""
