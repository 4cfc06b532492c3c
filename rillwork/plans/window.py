"""Half-open windows of days."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Days:
    """The days from since to before until; either bound may be missing."""

    since: date | None = None
    until: date | None = None

    def __post_init__(self):
        if self.since and self.until and self.since >= self.until:
            raise ValueError("a window ends after it starts")

    @classmethod
    def parse(cls, since: str | None, until: str | None) -> Days:
        return cls(since and date.fromisoformat(since), until and date.fromisoformat(until))

    @property
    def open(self) -> bool:
        return self.since is None and self.until is None

    def earlier(self, days: int) -> Days:
        """The window with so many more days before it."""
        return Days(self.since and self.since - timedelta(days), self.until)

    def each(self, days: int = 1) -> list[Days]:
        """Its days as windows of so many days, the last maybe shorter; both bounds are needed."""
        if self.since is None or self.until is None:
            raise ValueError("both bounds are needed")
        starts = range(0, (self.until - self.since).days, days)
        return [Days(self.since + timedelta(k), min(self.since + timedelta(k + days), self.until)) for k in starts]
