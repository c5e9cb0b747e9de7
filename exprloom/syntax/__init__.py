"""Lexer, syntax tree and parser of the expression language."""

from .lexer import Token, tokenize
from .parser import parse

__all__ = ["Token", "parse", "tokenize"]
