"""A PySpark-native expression engine: safe user expressions compiled to Spark columns."""

from .engine import CompiledExpression, Engine, Validation, evaluate_expression, references
from .errors import EngineError, ExpressionError, ExpressionReferenceError, ExpressionTypeError, SecurityError, format_any, format_error
from .plans.fold import fold
from .syntax import parse, tokenize

__all__ = [
    "CompiledExpression", "Engine", "EngineError", "ExpressionError", "ExpressionReferenceError", "ExpressionTypeError", "SecurityError",
    "Validation", "evaluate_expression", "fold", "format_any", "format_error", "parse", "references", "tokenize",
]
