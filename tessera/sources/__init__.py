"""Readers and writers of binary containers."""
