"""Structured Streaming forms of the request flow."""
