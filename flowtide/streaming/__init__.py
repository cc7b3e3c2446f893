"""Incremental analysis of a growing folder of sources."""
