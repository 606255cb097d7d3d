"""Readers and writers, and adapters from the driver's tables."""
