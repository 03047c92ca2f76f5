"""Readers and writers of run files."""
