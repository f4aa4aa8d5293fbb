"""Exceptions of log consumption, and how they are told apart."""

from __future__ import annotations


class LogError(Exception):
    """Base of all errors raised here."""


class Stopped(LogError):
    """The stream or server was stopped."""


class HeadReached(LogError):
    """A stream that ends at the head has ended."""


class NotIncreasing(LogError):
    """Two events in a row whose ids do not rise."""


class InvalidId(LogError):
    """A cursor or id that is not an integer where one is needed."""


class CursorNotIncreasing(LogError):
    """A cursor set to a value that is not above the stored one."""


class BatchState(LogError):
    """A batch failed in the background; the consumer must be reset."""


class InvalidBatchConfig(LogError):
    """A batch needs a length or a period."""


class InvalidEvent(LogError):
    """An event that may not be inserted."""


class ReservationLost(LogError):
    """Ids that a writer had reserved were given to another in the meantime."""


class DeserializationError(LogError):
    """Metadata that its reader cannot decode."""


class FilterError(LogError):
    """An event filter failed."""


class CursorOutOfRange(LogError):
    """A blob cursor past the records of its blob."""


class CursorAtEnd(LogError):
    """A blob cursor at the last record, which should have been stored as the end mark."""


def is_stopped(error: BaseException | None) -> bool:
    return isinstance(error, Stopped)


def is_head_reached(error: BaseException | None) -> bool:
    return isinstance(error, HeadReached)


def is_expected(error: BaseException | None) -> bool:
    """Errors that end a run in the ordinary way: cancelled, out of time, stopped."""
    return isinstance(error, (Stopped, KeyboardInterrupt, TimeoutError))


def is_filter_error(error: BaseException | None) -> bool:
    return isinstance(error, FilterError)


def is_deserialization_error(error: BaseException | None) -> bool:
    return isinstance(error, DeserializationError) or isinstance(error, FilterError) and isinstance(error.__cause__, DeserializationError)
