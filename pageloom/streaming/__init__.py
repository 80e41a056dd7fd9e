"""Incremental extraction: the batch operators over pages as they land."""
