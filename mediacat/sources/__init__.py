"""Readers and keyed table writers."""
