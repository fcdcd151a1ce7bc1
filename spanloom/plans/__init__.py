"""Layers derived from the given tables, and the queries over them."""
