"""Readers, writers, validation and the shared working folder."""
