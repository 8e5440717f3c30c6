"""Incremental feature runs over landed files."""
