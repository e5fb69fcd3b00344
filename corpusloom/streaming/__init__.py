"""Scans of files as they arrive."""
