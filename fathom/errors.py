"""Errors that a caller can act on."""

from __future__ import annotations

import time
from collections.abc import Callable


class QueryError(ValueError):
    """The request names something that does not exist, is ambiguous or is not allowed there."""


class DeniedError(PermissionError):
    """The caller may not read or write this type, row or field."""


class SchemaError(ValueError):
    """A type's declaration contradicts itself or what is stored."""


class UnavailableError(RuntimeError):
    """Something that the request needs cannot be reached now; it may be tried again."""


class PreconditionError(RuntimeError):
    """The request cannot be served as the engine is set up: a store is switched off."""


# What callers of a remote interface are told.
STATUS = ((QueryError, "invalid_argument"), (DeniedError, "permission_denied"), (SchemaError, "failed_precondition"), (PreconditionError, "failed_precondition"), (UnavailableError, "unavailable"))


def status(error: BaseException) -> str:
    """The kind of an error; `internal` for those that are not the caller's business."""
    return next((name for kind, name in STATUS if isinstance(error, kind)), "internal")


class Breaker:
    """Calls of something that may be down: after some failures in a row it is not asked again for a while."""

    def __init__(self, call: Callable, failures: int = 5, wait: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.call, self.failures, self.wait, self.clock = call, failures, wait, clock
        self.failed, self.since = 0, 0.0

    def __call__(self, *args):
        if self.failed >= self.failures and self.clock() - self.since < self.wait:
            raise UnavailableError("not asked again yet after failures in a row")
        try:
            out = self.call(*args)
        except Exception as e:
            self.failed, self.since = self.failed + 1, self.clock()
            raise UnavailableError(str(e)) from e
        self.failed = 0
        return out
