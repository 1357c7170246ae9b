"""Uploads that arrive as files."""
