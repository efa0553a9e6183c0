"""Readers and writers for landed files and partitioned tables."""
