"""Incremental analysis over a stream of package files."""
