"""Readers and writers of the stored formats."""
