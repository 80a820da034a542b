"""Options of a comparison."""

from __future__ import annotations

import math
from dataclasses import dataclass

TOP = 25


class UsageError(ValueError):
    """What the caller asked for can't be run at all; unlike a refusal it has no verdict."""


@dataclass(frozen=True)
class CompareOptions:
    key: str | None = None
    threshold: float = 0.95
    tolerance: float = 1e-9
    delimiter: str | None = None
    profile: str | None = None
    profile_id: str | None = None
    profile_dir: str | None = None
    exhaustive: bool = False
    audit_fields: bool = False
    max_audit_changes: int = 10_000
    explicit: bool = False

    def __post_init__(self) -> None:
        if not (math.isfinite(self.threshold) and 0 < self.threshold <= 1):
            raise UsageError("threshold must be above 0 and at most 1")
        if not (math.isfinite(self.tolerance) and self.tolerance >= 0):
            raise UsageError("tolerance must be finite and not negative")
        if self.max_audit_changes < 1:
            raise UsageError("max_audit_changes must be at least 1")
