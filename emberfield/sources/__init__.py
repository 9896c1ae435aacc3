"""Readers, writers and fetch planning for landed sensor files."""
