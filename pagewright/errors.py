"""What can go wrong, as one tree."""

from __future__ import annotations


class EngineError(Exception):
    """The base of all errors of this package."""


class DocumentError(EngineError, ValueError):
    """A document that is no JSON object."""


class BackendError(EngineError, RuntimeError):
    """The server cannot be reached or answers nothing usable."""


class BudgetExhausted(EngineError):
    """A limit of a run was reached where the caller asked for an error instead of a status."""


class ReplyError(EngineError, RuntimeError):
    """A reply, and the one after a correction, do not fit the schema."""

    def __init__(self, model_id: str, reason: str):
        super().__init__(f"{model_id}: {reason}")
        self.model_id, self.reason = model_id, reason

    def __reduce__(self):
        return type(self), (self.model_id, self.reason)
