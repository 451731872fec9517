"""What was asked and how long it took: counters that can be marked and read since a mark."""

from __future__ import annotations

from collections import Counter, deque
from typing import Any

from .results import Query


class Stats:
    """Counters of measured queries: queries, rows, seconds, and leaves by operator and by how they were answered."""

    def __init__(self, keep: int = 100):
        self.totals: Counter = Counter()
        self.recent: deque[dict[str, Any]] = deque(maxlen=keep)

    def run(self, query: Query) -> dict[str, Any]:
        """Measure a query and count it."""
        got = query.measure()
        self.totals.update({"queries": 1, "rows": got["rows"], "seconds": got["seconds"]})
        self.totals.update(Counter(f"operator:{kind}" for _, kind, _ in got["leaves"]))
        self.totals.update(Counter(f"answered:{how}" for _, _, how in got["leaves"]))
        self.recent.append(got)
        return got

    def mark(self) -> Counter:
        return Counter(self.totals)

    def since(self, mark: Counter) -> dict[str, Any]:
        """What was counted after ``mark``."""
        return {k: v - mark[k] for k, v in self.totals.items() if v != mark[k]}
