"""The engine's exception type; ``code`` is stable and meant for programs."""

from __future__ import annotations

#: Every code that an error of this engine can carry.
CODES = (
    "INVALID_ARGUMENT",
    "DIMENSION_MISMATCH",
    "INVALID_VECTOR",
    "INDEX_FULL",
    "COMPACTION_REQUIRED",
    "SNAPSHOT_INVALID",
    "LAYER_INVALID",
    "NOT_FOUND",
)


class SkerryError(ValueError):
    """An error with a stable ``code``."""

    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise ValueError(f"unknown error code {code!r}")
        super().__init__(f"{code}: {message}")
        self.code = code


def require(condition: bool, message: str, code: str = "INVALID_ARGUMENT") -> None:
    if not condition:
        raise SkerryError(code, message)
