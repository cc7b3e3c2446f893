"""Relational and graph operators over the flow tables."""
