"""Incremental forms: change logs, upserts and state."""
