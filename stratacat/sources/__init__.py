"""Readers and parsers of seller feeds, pages and reports."""
