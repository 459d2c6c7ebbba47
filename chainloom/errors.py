"""Errors of reads, writes and parsers, with the status each maps to."""

from __future__ import annotations


class ChainError(Exception):
    """Base; ``status`` is what a service would answer."""

    status = "INTERNAL"


class NotFound(ChainError):
    status = "NOT_FOUND"


class InvalidArgument(ChainError):
    status = "INVALID_ARGUMENT"


class OutOfRange(InvalidArgument):
    """An empty or inverted range."""


class InvalidEventId(InvalidArgument):
    """A cursor beyond the end of the event log."""


class FailedPrecondition(ChainError):
    status = "FAILED_PRECONDITION"


class NoEventHistory(NotFound):
    """An event stream without events, or soft-deleted."""


class NotImplementedForChain(ChainError):
    status = "UNIMPLEMENTED"


class Aborted(ChainError):
    status = "ABORTED"


class Canceled(ChainError):
    status = "CANCELLED"


class DeadlineExceeded(ChainError):
    status = "DEADLINE_EXCEEDED"


class Discontinuous(ChainError):
    """Blocks or events that don't follow one another."""


def status_of(error: BaseException) -> str:
    """Status of any error; those of other kinds are internal."""
    if isinstance(error, TimeoutError):
        return DeadlineExceeded.status
    return getattr(error, "status", ChainError.status)
