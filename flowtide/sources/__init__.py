"""Readers and writers: repository files, source text, IR documents, tables."""
