"""Landed payloads, tables on disk and keyed upserts."""
