"""Readers, log parsers and writers."""
