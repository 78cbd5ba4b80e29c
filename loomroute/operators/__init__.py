"""Relational operators over plan data."""
