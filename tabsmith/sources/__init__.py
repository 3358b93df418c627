"""Readers, writers and the snapshot catalog."""
