"""Incremental import and decisions on streams."""
