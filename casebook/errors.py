"""Errors of the public functions."""


class CasebookError(Exception):
    """Base of all errors raised here."""


class ValidationError(CasebookError):
    """An argument is out of its allowed range."""


class NotFoundError(CasebookError):
    """A case, hold, event or pattern does not exist."""


class ParseError(CasebookError):
    """A payload cannot be parsed."""


class PayloadTooLargeError(CasebookError):
    """A payload exceeds its byte limit."""
