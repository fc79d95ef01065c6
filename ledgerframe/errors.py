"""Typed refusals. An answer is complete or it is one of these."""

from __future__ import annotations


class LedgerError(Exception):
    """Base of all refusals."""


class SchemaRefused(LedgerError, ValueError):
    """A declaration that cannot be stored, or one that contradicts the stream's history."""


class PredicateRefused(LedgerError, ValueError):
    """A ``where`` or ``filters`` that names what isn't there or means nothing."""


class RowsRefused(LedgerError, ValueError):
    """Rows that the declared schema does not admit; ``row`` is the first of them, from 0."""

    def __init__(self, message: str, row: int | None = None):
        super().__init__(message)
        self.row = row


class CommitConflict(LedgerError):
    """Another writer committed first."""


class LogSealed(CommitConflict):
    """The log takes no more rows: its stream was migrated or retired since the handle was opened."""


class StreamNotFound(LedgerError):
    pass


class StreamExists(LedgerError):
    pass


class StreamRetired(LedgerError):
    pass


class StreamMismatch(LedgerError):
    """A name that stands for another stream than the one asked for."""


class SnapshotUnavailable(LedgerError):
    """History that nobody holds in full."""


class NotReplayable(LedgerError):
    """A resume offset that cannot be served: ``reason`` is not_durable, evicted, ahead or too_old."""

    def __init__(self, reason: str, requested: int, bound: int | None):
        super().__init__(f"{reason}: requested offset {requested}, bound {bound}")
        self.reason, self.requested, self.bound = reason, requested, bound


class SequenceGap(LedgerError):
    """A publisher's frame that leaves out sequence numbers."""

    def __init__(self, publisher: str, got: int, expected: int):
        super().__init__(f"publisher {publisher!r} sent {got}, expected at most {expected}")
        self.publisher, self.got, self.expected = publisher, got, expected


class AcknowledgedRowsLost(LedgerError):
    pass


class StoreBehindBroker(LedgerError):
    pass


class CursorMovedBack(LedgerError):
    pass


class TailTooLarge(LedgerError):
    pass


class SourceUnreadable(LedgerError):
    """A store, folder or file that the streaming source can't read."""


class OffsetsOutOfOrder(LedgerError):
    """A reader was given an offset that isn't above the one before."""


class FellBehind(LedgerError):
    """A reader let more rows wait than it may."""
