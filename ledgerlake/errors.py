"""Errors that callers can tell apart."""

from __future__ import annotations


class LedgerError(Exception):
    """The base of all errors here."""


class TableNotFound(LedgerError):
    pass


class ColumnNotFound(LedgerError):
    def __init__(self, table: str, column: str):
        super().__init__(f"{table} has no column {column}")
        self.table, self.column = table, column


class ParameterNotFound(LedgerError):
    def __init__(self, number: int):
        super().__init__(f"no value is bound to parameter {number}")
        self.number = number


class TypeMismatch(LedgerError):
    def __init__(self, expected: str, actual: str):
        super().__init__(f"expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class UnsupportedFeature(LedgerError):
    pass


class PositionAhead(LedgerError):
    def __init__(self, asked: int, applied: int):
        super().__init__(f"position {asked} is ahead of the applied position {applied}")
        self.asked, self.applied = asked, applied


class NonSequentialBatch(LedgerError):
    pass


class UnexpectedStreamOffset(LedgerError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"the stream is at offset {actual}, not {expected}")
        self.expected, self.actual = expected, actual


class ChainVerificationFailed(LedgerError):
    pass


class CorruptedRecord(LedgerError):
    pass


class ScopeViolation(LedgerError):
    pass


class TokenNotFound(LedgerError):
    pass


class TokenRevoked(LedgerError):
    pass


class TokenExpired(LedgerError):
    """Out of time or out of uses."""


class ConsentNotFound(LedgerError):
    pass


class KeyRequired(LedgerError):
    pass


class StreamIdTaken(LedgerError):
    pass
