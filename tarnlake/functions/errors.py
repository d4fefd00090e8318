"""What can go wrong, with where it did."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, collection: str | None = None, id: str | None = None, reason: str | None = None):
        super().__init__(message)
        self.collection, self.id, self.reason = collection, id, reason


class InvalidArgument(EngineError, ValueError):
    """A call that can't be right, whatever the data."""


class Conflict(EngineError):
    """An update whose condition did not hold; the reason is one of those that compare_and_set() and update() give."""
