"""Errors raised by the engine."""


class EngineError(Exception):
    """Base of every error that the engine raises on purpose."""


class BadSyntaxError(EngineError):
    """The statement does not follow the grammar."""

    def __init__(self, detail: str) -> None:
        super().__init__(f"bad syntax: {detail}")


class UnknownTable(EngineError):
    """No table or view has this name."""


class UnknownField(EngineError):
    """No input has a field of this name."""


class UnknownIndex(EngineError):
    """No index has this name or covers this field."""


class DuplicateName(EngineError):
    """A table, view or index of this name exists already."""


class TypeMismatch(EngineError):
    """A value does not fit the type or the length of its field."""


class Conflict(EngineError):
    """Another transaction committed a table that this one read or wrote."""


class TransactionClosed(EngineError):
    """The transaction was committed or rolled back before."""


class CyclicView(EngineError):
    """A view refers to itself, directly or through other views."""
