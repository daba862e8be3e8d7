"""Readers, writers and the durable work folder."""
