"""Readers, writers, keyed table updates and document extraction."""
