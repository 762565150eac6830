"""Readers: tables, values, databases, file listings and archives."""
