"""Relational operators over logs, catalogs, codes, vectors and rankings."""
