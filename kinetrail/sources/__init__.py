"""Readers, writers and the stand-in views."""
