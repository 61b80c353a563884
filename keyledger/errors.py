"""Errors raised by the ledger."""


class LedgerError(Exception):
    """A ledger could not be opened, read or committed."""


class NotAppendable(LedgerError):
    """An append-update was asked of a ledger whose values have no combiner."""


class LedgerClosed(LedgerError):
    """An operation was sent to a ledger after it was closed."""
