"""Errors of the engine, in the families a caller can act on."""

from __future__ import annotations


class GraphError(Exception):
    pass


class TransientError(GraphError):
    """Trying again may help."""


class DataError(GraphError):
    """What was asked for does not fit the data."""


class FatalError(GraphError):
    pass


class NotFound(DataError):
    pass


class ConstraintViolation(DataError):
    pass


class SchemaError(DataError):
    pass


class CorruptionDetected(FatalError):
    pass


class GraphClosed(FatalError):
    pass


class RemoteError(TransientError):
    pass


class QueryError(GraphError):
    """A query with the place of the fault, if known."""

    def __init__(self, message: str, text: str | None = None, at: int | None = None, token: str | None = None) -> None:
        self.message, self.token = message, token
        self.line = self.column = None
        if text is not None and at is not None:
            before = text[:at]
            self.line = before.count("\n") + 1
            self.column = at - (before.rfind("\n") + 1) + 1
            row = text.split("\n")[self.line - 1]
            message = f"{message} at line {self.line}, column {self.column}\n{row}\n{' ' * (self.column - 1)}^"
        super().__init__(message)


class LexError(QueryError):
    pass


class ParseError(QueryError):
    pass


class PlanError(QueryError):
    pass


class EvalError(QueryError):
    pass
