"""Readers, writers, stage tables and table bindings."""
