"""Relational operators over measurement tables and block data."""
