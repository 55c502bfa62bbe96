"""Registered queries: an operator over the given tables, and its oracle SQL."""
