"""Contract constraints: dispatch only in hour windows and on eligible
weekdays, cap qualifying events per day and per week, bound durations.

Rules of one tick, or of one quarter's first tick, as SQL text: they are written
out for each series of a zone, and one text a column keeps the plan's
construction short.  Arguments are column names or expressions; the columns of a
date and hour (``weekday_ok``, ``inside``, ``min_duration`` and so on) are taken by name.
"""

from __future__ import annotations


def constrained_dispatch(outside_flag: bool, strike: str, dispatch: str) -> str:
    """Dispatch allowed by the windows and weekdays.  Entering a window while
    the strike is on forces a dispatch (``entry``, see ``window_entry``)."""
    in_window = f"CASE WHEN {strike} = 1 AND entry THEN 1 ELSE {dispatch} END"
    if outside_flag:
        return f"CASE WHEN weekday_ok = 1 THEN CASE WHEN outside AND min_duration > 0 THEN {dispatch} WHEN inside THEN {in_window} ELSE 0 END ELSE 0 END"
    return f"CASE WHEN outside THEN 0 WHEN weekday_ok = 1 THEN {in_window} ELSE 0 END"


def constrained_marker(outside_flag: bool, strike: str, cdispatch: str, day_start: str) -> str:
    """Start of a constrained event: a constrained dispatch, or the strike on at the first tick of a date."""
    in_reach = "" if outside_flag else " AND inside"
    return f"CASE WHEN {cdispatch} = 1 OR ({strike} = 1 AND {day_start}{in_reach}) THEN 1 ELSE 0 END"


def within_daily_cap(n: str) -> str:
    """How many of a day's first ``n`` qualifying events the daily cap lets count for the week."""
    return f"least(bigint({n}), bigint(greatest(daily_max, 0)))"


def constrained_duration(outside_flag: bool, d: str, duration: str, daily: str, weekly: str) -> str:
    """The constrained duration (NULL = not paid) from the running one ``d``, given the daily and weekly counts."""
    over_cap = f"({weekly} > weekly_max OR {daily} > daily_max) AND {d} >= min_duration"
    inside_rule = f"CASE WHEN {over_cap} THEN NULL WHEN {d} > max_duration OR late_out THEN NULL ELSE {d} END"
    outside_rule = f"CASE WHEN {duration} >= min_duration THEN NULL ELSE {duration} END" if outside_flag else "NULL"
    return f"double(CASE WHEN inside THEN {inside_rule} ELSE {outside_rule} END)"
