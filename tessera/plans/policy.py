"""When to commit and when to compact: pure rules over numbers that a collection's head keeps. Times are in milliseconds."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

Clock = Callable[[], int]


def system_clock() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class Versioning:
    """Commit by itself once so many inserted points are pending, or so long after the last commit when a write comes; neither: only on request."""

    every_n_writes: int | None = None
    interval_ms: int | None = None


def pending_after_commit(policy: Versioning, pending: int, elapsed: int) -> int | None:
    """What stays pending after the commit that is due now; None if none is due.

    Counting on from what is over the quota keeps later commits at its multiples; a commit by time starts anew.
    """
    quota = policy.every_n_writes
    if quota is not None and pending >= quota:
        return pending - quota
    waited = policy.interval_ms is not None and elapsed >= policy.interval_ms
    return 0 if pending and waited else None


@dataclass(frozen=True)
class Compaction:
    """Compact at so many segments or so long after the last time; None disables either."""

    max_segments: int | None = 8
    interval_ms: int | None = 300_000

    @classmethod
    def from_settings(cls, settings: dict[str, str], segments: str = "max_segments", seconds: str = "interval_seconds") -> Compaction:
        """Numbers from text; 0 or anything that isn't a number disables."""
        read = lambda k, default: default if k not in settings else int(settings[k]) if str(settings[k]).isdigit() else 0
        n, s = read(segments, 8), read(seconds, 300)
        return cls(n or None, s * 1000 or None)


def compaction_due(policy: Compaction, segments: int, elapsed: int) -> bool:
    """Whether several segments have become too many, or have stood for too long."""
    limits = ((policy.max_segments, segments), (policy.interval_ms, elapsed))
    return segments > 1 and any(most is not None and now >= most for most, now in limits)


def should_rebuild(deleted: int, total: int, ratio: float = 0.30) -> bool:
    return total > 0 and deleted / total >= ratio
