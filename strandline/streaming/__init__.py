"""Structured Streaming forms of the bounded operators."""
