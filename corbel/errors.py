"""Exceptions."""


class CorbelError(Exception):
    """Base of this library's errors."""


class ExpressionError(CorbelError):
    """An expression cannot be used."""


class ExpressionSyntaxError(ExpressionError):
    """An expression is no valid arithmetic."""


class UnsafeExpressionError(ExpressionError):
    """An expression holds more than numbers, names, + - * / and signs."""


class MissingVariableError(ExpressionError):
    """An expression names a column that is not there."""

    def __init__(self, missing: list[str]):
        super().__init__(f"no such columns: {', '.join(missing)}")
        self.missing = missing


class ScoringError(CorbelError):
    """A score or its scale is out of range."""


class SpecError(CorbelError):
    """A scoring specification cannot be built, read or used."""


class UnsupportedStepError(SpecError):
    """A pipeline step has no scoring form."""


class ConsistencyError(SpecError):
    """Two ways to score disagree."""
