"""Event-window and weekday predicates over the per-month constraint columns.

Windows are half-open hour ranges [w1_start, w1_end) and [w2_start, w2_end).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeflow.params import WEEKDAYS


def _c(name: str) -> Column:
    return F.col(name)


def in_windows(hour: Column) -> Column:
    """Hour inside either event window."""
    return ((hour >= _c("w1_start")) & (hour < _c("w1_end"))) | (
        (hour >= _c("w2_start")) & (hour < _c("w2_end"))
    )


def outside_windows(hour: Column) -> Column:
    """Before window 1, between the windows, or after window 2.

    Not the negation of ``in_windows`` when the windows overlap or are out of
    order; both forms are used by the model.
    """
    return (
        (hour < _c("w1_start"))
        | ((hour >= _c("w1_end")) & (hour < _c("w2_start")))
        | (hour >= _c("w2_end"))
    )


def late_outside(hour: Column) -> Column:
    """The part of ``outside_windows`` after window 1 starts (duration rule)."""
    return ((hour >= _c("w1_end")) & (hour < _c("w2_start"))) | (hour >= _c("w2_end"))


def window_entry(hour: Column, prev_hour: Column, mode: str) -> Column:
    """Does this tick open an event window?

    'as_written': previous tick's hour below either window start (the original
    test, which holds for most of window 1 with the shipped windows).
    'boundary': previous tick's hour outside the window that holds this hour.
    A missing previous hour gives False.
    """
    if mode == "as_written":
        return F.coalesce(
            (prev_hour < _c("w1_start")) | (prev_hour < _c("w2_start")), F.lit(False)
        )
    if mode == "boundary":
        def inw(h, s, e):
            return (h >= _c(s)) & (h < _c(e))

        enter1 = inw(hour, "w1_start", "w1_end") & ~inw(prev_hour, "w1_start", "w1_end")
        enter2 = inw(hour, "w2_start", "w2_end") & ~inw(prev_hour, "w2_start", "w2_end")
        return F.coalesce(enter1 | enter2, F.lit(False))
    raise ValueError(f"unknown window_entry mode {mode!r}")


def weekday_eligible(weekday: Column) -> Column:
    """0/1 flag of the row's weekday (Mon=0) from the mon..sun columns."""
    return F.element_at(F.array(*[_c(d) for d in WEEKDAYS]), weekday + 1)
