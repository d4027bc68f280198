"""Structured Streaming forms of operators whose parameters are frozen."""
