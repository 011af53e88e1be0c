"""Readers, writers and table checks."""
