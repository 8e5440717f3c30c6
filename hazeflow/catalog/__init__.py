"""Queries over the sample tables, each with a plain SQL twin where one exists."""
