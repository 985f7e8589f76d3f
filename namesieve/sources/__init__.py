"""Readers and writers for list files and stored tables."""
