"""Readers and adapters that turn files and payloads into tables."""
