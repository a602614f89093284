"""Errors with machine-readable codes."""

from __future__ import annotations


class ExpressionError(ValueError):
    """An expression that cannot be parsed, typed or evaluated."""

    def __init__(self, code: str, message: str, expression: str = ""):
        super().__init__(message)
        self.code, self.message, self.expression = code, message, expression


class DataError(ValueError):
    """Input tables that break their contract."""
