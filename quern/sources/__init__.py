"""Readers, schemas, sinks and the fact store."""
