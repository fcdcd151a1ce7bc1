"""Relational operators over position-keyed layers."""
