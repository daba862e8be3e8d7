"""Queries over inventories derived from the given tables, each with its SQL counterpart."""
