"""Operators and native methods of the language as Spark expressions."""
