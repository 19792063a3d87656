"""Readers of the archive's formats and writers of results."""
