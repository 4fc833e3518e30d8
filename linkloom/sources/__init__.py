"""Readers, parsers and entity views."""
