"""Readers: driver tables, blobs, text lines, and the binary containers."""
