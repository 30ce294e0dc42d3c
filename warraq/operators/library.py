"""Selections over the library: visible books, filters from selections, needles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from ..schema import ALL_BOOKS, UNCLASSIFIED, UNCLASSIFIED_NAMES, UNKNOWN_YEAR
from .search import TimeMode

COLUMN = {"category": "category", "region": "country"}


@dataclass(frozen=True)
class Selection:
    """What is ticked in one list: ``view`` is category, year or region."""

    view: str
    chosen: frozenset[str]
    available: frozenset[str] = frozenset()
    time_mode: TimeMode = TimeMode.DEATH_YEAR

    @property
    def column(self) -> str:
        return self.time_mode.value if self.view == "year" else COLUMN[self.view]


def visible_books(books: DataFrame, selection: Selection) -> DataFrame:
    """Nothing chosen shows nothing, ALL everything, else members and (if chosen) the unclassified."""
    if not selection.chosen:
        return books.limit(0)
    if ALL_BOOKS in selection.chosen:
        return books
    c = F.col(selection.column)
    named = sorted(selection.chosen - {UNCLASSIFIED})
    keep = c.isin(*named) if named else F.lit(False)
    if UNCLASSIFIED in selection.chosen:
        missing = blank(c) | (c == UNKNOWN_YEAR) if selection.view == "year" else blank(c)
        keep = keep | missing
    return books.where(F.coalesce(keep, F.lit(False)))


def effective_filter(selection: Selection) -> tuple[str, ...] | None:
    """The search filter of a selection; none for nothing, for ALL, and for everything ticked."""
    chosen = selection.chosen
    if not chosen or ALL_BOOKS in chosen or (selection.available and chosen >= selection.available):
        return None
    named = sorted(chosen - {UNCLASSIFIED})
    if UNCLASSIFIED in chosen and selection.view == "category":
        named.append(UNCLASSIFIED_NAMES[0])
    return tuple(named) or None


def containing(df: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose value contains the trimmed needle, case-sensitively; a blank needle keeps all."""
    needle = needle.strip()
    return df.where(F.col(column).contains(needle)) if needle else df


def reapplied(names: DataFrame, column: str, saved: list[str]) -> DataFrame:
    """Which of the names a saved selection ticks."""
    return names.withColumn("selected", F.coalesce(F.col(column).isin(*saved) if saved else F.lit(False), F.lit(False)))
