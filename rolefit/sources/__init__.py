"""Readers and the adapters over the test tables."""
