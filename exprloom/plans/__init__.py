"""Syntax trees to Spark columns: constant folding and lowering."""
