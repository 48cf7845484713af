"""Readers: dump text, ownership lists and captured responses."""
