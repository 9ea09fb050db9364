"""Readers and writers for message tables, exports and reports."""
