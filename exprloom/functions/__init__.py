"""Typed columns, coercions between their types, and the standard library."""
