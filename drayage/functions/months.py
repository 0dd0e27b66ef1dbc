"""Months on one integer axis (year * 12 + month - 1)."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple


class Month(NamedTuple):
    year: int
    month: int

    @property
    def index(self) -> int:
        return self.year * 12 + self.month - 1

    def plus(self, n: int) -> Month:
        year, zero_based = divmod(self.index + n, 12)
        return Month(year, zero_based + 1)

    @property
    def start(self) -> dt.datetime:
        return dt.datetime(self.year, self.month, 1)

    def __str__(self) -> str:
        return f"{self.year:04d}-{self.month:02d}"


def span(lo: Month, hi: Month) -> list[Month]:
    """Every month from ``lo`` through ``hi``; empty when ``lo`` is after ``hi``."""
    return [lo.plus(i) for i in range(hi.index - lo.index + 1)]
