"""Readers and writers of record and match files."""
