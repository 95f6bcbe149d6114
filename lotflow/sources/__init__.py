"""Readers and writers for event files, dimensions and keyed tables."""
