"""Readers, writers and pluggable sources."""
