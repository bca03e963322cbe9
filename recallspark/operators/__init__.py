"""Relational operators over calls, records and entries."""
