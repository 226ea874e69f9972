"""What an event table's columns and categories mean."""

from __future__ import annotations

from dataclasses import dataclass

#: Seasons of the year in order; December belongs to the next winter.
SEASONS = ("DJF", "MAM", "JJA", "SON")


@dataclass(frozen=True)
class PanelConfig:
    """base_year: the season_year of season_idx 0..3. partial_seasons: indexes
    of incomplete boundary seasons. test_start: the first held-out season_year.
    sentinel: the category that stands for a missing one. natural: the label of
    the natural class; every other label but the sentinel is human."""

    base_year: int
    partial_seasons: tuple[int, ...]
    last_idx: int
    test_start: int
    sentinel: str
    natural: str
    human: tuple[str, ...]
    k: int = 7

    @property
    def vocabulary(self) -> tuple[str, ...]:
        return tuple(sorted((self.natural, *self.human)))


CELL = ["place", "season", "season_idx", "season_year"]
SERIES = ["place", "season"]
